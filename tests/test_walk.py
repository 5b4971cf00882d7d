"""The partitioned walk, rules of many roots, and files on other storages dealt by their bytes."""

import os
import random

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from tokenloom.sources import discover as D
from tokenloom.sources import ignore as I
from tokenloom.sources.places import Places


def shape(root, seed, folders, links):
    """Folders, files and links (up, down, in circles, to nowhere) below a root."""
    r, made = random.Random(seed), [root]
    os.makedirs(root)
    for i in range(folders):
        at = os.path.join(r.choice(made[-200:]), r.choice(["src", "lib", "node_modules", "vendor", "x", "y-z", "é"]) + str(i % 50 or ""))
        if not os.path.exists(at):
            os.mkdir(at)
            made.append(at)
    for i in range(folders // 3):
        with open(os.path.join(r.choice(made), r.choice(["a.ts", ".dot", "_x", "b.log", "keep.log"])), "w") as f:
            f.write("x" * (i % 7))
    for i in range(links):
        at = os.path.join(r.choice(made), f"link{i}")
        if not os.path.lexists(at):
            os.symlink(r.choice([*made, root, at, "/nowhere"]), at)
    with open(os.path.join(root, ".gitignore"), "w") as f:
        f.write("*.log\n!keep.log\nvendor*/\nlib3/\n")
    return made


def walked(root, **options):
    return sorted(D.walk(root, I.IgnoreRules.of_root(root), **options), key=str)


def found(df):
    return sorted(((r.path, r.relative, r.size, r.mtime, r.outcome) for r in df.collect()), key=str)


@pytest.mark.parametrize(("folders", "links"), [(60, 0), (300, 60)])
def test_as_the_walk_of_one_machine(spark, tmp_path, folders, links):
    root = str(tmp_path / "r")
    shape(root, folders, folders, links)
    marks = []
    df = D.discover(spark, [root], on_progress=marks.append)
    assert found(df) == walked(root)
    assert marks == sorted(marks) and marks[-1] == df.where("outcome = 'file'").count() and len(marks) > 3
    rules = I.IgnoreRules.of_root(root)
    assert all(r.ignored == (r.outcome == "ignored-directory" or rules.is_ignored(r.relative)) for r in df.collect())
    assert found(D.discover(spark, [root], prune_ignored=False)) == walked(root, prune_ignored=False)
    assert D.discover(spark, [root], respect_ignore=False).where("ignored").count() == 0


def test_many_folders_in_many_tasks(spark, tmp_path):
    """A level of 2,000 folders takes tasks by their number; no folder is listed twice, whatever links say."""
    root = tmp_path / "r"
    for i in range(40):
        for j in range(50):
            (root / f"d{i}" / f"e{j}").mkdir(parents=True)
    for i in range(40):
        (root / f"d{i}" / "again").symlink_to(root / f"d{(i + 1) % 40}")
        (root / f"d{i}" / "e1" / "f").write_text("x")
    tracker, before = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    df = D.discover(spark, [str(root)])
    jobs = [tracker.getJobInfo(j) for j in range(before, spark.sparkContext._jsc.sc().dagScheduler().nextJobId())]
    tasks = [tracker.getStageInfo(s).numTasks for j in jobs if j for s in j.stageIds if tracker.getStageInfo(s)]
    assert max(tasks) >= 2_000 // D.FOLDERS
    assert found(df) == walked(str(root)) and df.count() == 40


def test_roots_of_all_kinds(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "f").write_text("1")
    (tmp_path / "b.txt").write_text("22")
    (tmp_path / "a" / os.fsdecode(b"\xff")).write_text("3")
    roots = spark.createDataFrame([(str(tmp_path / x),) for x in ("a", "b.txt", "none")], "root string")
    rows = sorted((r.relative, r.size, r.outcome) for r in D.discover(spark, roots).collect())
    assert rows == [("b.txt", 2, "file"), ("f", 1, "file"), ("none", None, "unreadable"), ("�", None, "unreadable")]
    assert D.discover(spark, []).count() == 0


def storage(folder):
    return lambda: fs.SubTreeFileSystem(folder, fs.LocalFileSystem())


def test_another_storage(spark, tmp_path):
    """Dotfiles, empty files and one of 10 MiB, by a URI that is no path of this machine."""
    for name, body in {".hidden": b"dot", "_under": b"u", "empty": b"", "d/big.txt": b"a" * (10 << 20), "d/too-big.txt": b"a" * ((10 << 20) + 1), "d/bin": b"a\0", "skip/x": b"x", ".gitignore": b"skip/\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    schemes = {"vault": storage(str(tmp_path))}
    df = D.discover(spark, ["vault:///"], schemes=schemes)
    rows = {r.relative: (r.size, r.outcome) for r in df.collect()}
    assert rows == {".hidden": (3, "file"), "_under": (1, "file"), "empty": (0, "file"), "d/big.txt": (10 << 20, "file"), "d/too-big.txt": ((10 << 20) + 1, "file"), "d/bin": (2, "file"), "skip": (None, "ignored-directory"), ".gitignore": (6, "file")}
    files = df.where("outcome = 'file' and size <= 10485760").select("path", "size")
    texts = {r.path: (r.n, r.skip) for r in D.read_texts(D.packed(files), schemes=schemes).select("path", F.length("text").alias("n"), "skip").collect()}
    assert texts == {"vault:///.hidden": (3, None), "vault:///_under": (1, None), "vault:///empty": (0, None), "vault:///d/big.txt": (10 << 20, None), "vault:///d/bin": (None, "binary"), "vault:///.gitignore": (6, None)}
    gone = spark.createDataFrame([("vault:///none",), (None,), ("nosuch://x",)], "path string")
    assert {r.skip for r in D.read_texts(gone, schemes=schemes).collect()} == {"unreadable"}


def test_places(tmp_path):
    (tmp_path / "x").write_text("1")
    places = Places()
    place, path = places.of(f"file://{tmp_path}/x")
    assert place.read(path, 9) == b"1" and place.look(path).kind == "file" and place.look(str(tmp_path)).kind == "directory"
    assert list(place.entries(str(tmp_path / "none"))) == [] and places.of("/a")[0] is place
    own = Places({"vault": storage(str(tmp_path))}).of("vault:///x")[0]
    assert [e.name for e in own.entries("vault:///")] == ["x"] and own.look("vault:///no").kind == "unreadable"


def test_tasks_differ_little_in_bytes(spark):
    r = random.Random(0)
    sizes = [r.choice([0, 10, 1000, 1 << 20, 9 << 20]) for _ in range(600)] + [None]
    df = spark.createDataFrame([(f"/f{i:04d}", s, "x") for i, s in enumerate(sizes)], "path string, size long, extra string")
    dealt = D.packed(df)
    assert dealt.columns == ["path", "size", "extra"] and dealt.count() == 601
    per = [r.s for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.coalesce("size", F.lit(0)) + D.OPEN_BYTES).alias("s")).collect()]
    assert len(per) > 10 and max(per) <= 2 * sorted(per)[len(per) // 2] and min(sorted(per)[1:]) * 2 >= sorted(per)[len(per) // 2]
    assert D.packed(df.limit(0)).count() == 0


def test_rules_of_a_thousand_roots(spark):
    """Each root its own rules, all in one plan, as each root's rules alone say."""
    r = random.Random(1)
    bits = ["*.log", "!keep.log", "build/", "/top", "a/**/b", "**/foo", "foo/**", "d?c", "[ab].c", "[!ab].c", "# no", "", "*", "!x", "logs/", "!logs/keep.log", "[z-a]", "a b", "é*"]
    names = ["app.log", "keep.log", "build", "top", "a", "b", "foo", "dxc", "a.c", "c.c", "x", "logs", "a b", "éa", "n\nl"]
    roots = {f"/r{i}": "\n".join(r.choice(bits) for _ in range(r.randrange(6))) for i in range(1000)}
    files = [(root, "/".join(r.choice(names) for _ in range(r.randrange(1, 5)))) for root in roots for _ in range(5)] + [("/none", "x"), ("/r0", ""), ("/r0", "../x"), (None, "x")]
    df = spark.createDataFrame([(a, b, 1) for a, b in files], "root string, relative string, n int")
    rules = spark.createDataFrame([*roots.items(), ("/unused", None)], "root string, rules string")
    out = I.with_ignored(df, rules)
    own = {root: I.IgnoreRules(I.parse_rules(text)) for root, text in roots.items()}
    want = sorted((str(a), b, own[a].is_ignored(b) if a in own else False) for a, b in files)
    assert sorted((str(x.root), x.relative, x.ignored) for x in out.collect()) == want and out.columns == ["root", "relative", "n", "ignored"]
    assert sum(x[2] for x in want) > 500
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= 2  # the rules' own, once


def test_last_rule_wins_in_one_expression():
    rules = I.IgnoreRules(I.parse_rules("*.a\n!b.a\nc*\n!cc\nccc/"))
    assert [rules.is_ignored(x) for x in ("x.a", "b.a", "c", "cc", "ccc", "cc/x", "ccc/x")] == [True, False, True, False, True, False, True]
    import re

    for d in (True, False):
        for x in ("x.a", "b.a", "c", "cc", "ccc", "d"):
            assert bool(re.match(rules.expression(d), x)) == rules._decide(x, d)
