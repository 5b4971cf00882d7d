import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tokenloom.llm import chat

TURNS = "conv_id long, turn long, role string, text string, formatted string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def turns(spark, rows):
    return spark.createDataFrame(rows, TURNS).select("conv_id", "turn", "role", chat.text_parts().alias("parts"))


def test_reading_back(spark):
    odd = "\\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", odd, "x"), (1, 0, "user", odd, None), (2, 0, None, None, None), (2, 0, None, None, None), (3, None, "a>\n<\\", "late", None), (3, 0, "assistant", "z" * 200_000, None), (None, 0, "assistant", "é😀", None)]
    out = {r.conv_id: r for r in chat.read_back(chat.format_turns(turns(spark, rows))).collect()}
    assert out[1].n_turns == 2 and out[1].turns_sha256 == sha(f"user\n{odd}\nassistant\n{odd}\n") and out[1].loss_sha256 == sha(odd) and out[1].loss_chars == len(odd)
    assert (out[2].n_turns, out[2].loss_chars, out[2].turns_sha256, out[2].loss_sha256) == (2, 0, sha("\n\n\n\n"), sha(""))
    assert out[3].turns_sha256 == sha("a>\n<\\\nlate\nassistant\n" + "z" * 200_000 + "\n")
    assert out[None].loss_chars == 2
    assert chat.read_back(chat.format_turns(turns(spark, []))).count() == 0


@given(st.text(alphabet="\\<>/turnlg \nx#", max_size=30))
@settings(max_examples=300, deadline=None)
def test_escapes(text):
    assert chat.unescape(chat.escape(text)) == text and "<" not in chat.escape(text)
    assert chat.unescape(chat.escape_role(text)) == text


def test_parts(spark):
    part = lambda kind, text=None, uri=None, w=None, h=None, s=None, p=None: (kind, text, uri, w, h, s, p)
    rows = [
        (1, 0, "user", [part("text", "see "), part("image", uri="i1", w=56, h=29), part("image", uri="i2", w=1, h=1), None]),
        (1, 1, "assistant", [part("text", "<ok>"), part("audio", uri="a1", s=1.5)]),
        (1, 2, "user", [part("document", uri="d", p=2), part("image", uri="i3"), part("strange", "as text")]),
        (1, 3, "user", None),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    out = chat.format_turns(df).orderBy("seq").collect()
    assert [r.formatted for r in out] == ["<turn user>\nsee <image 0><image 1></turn>\n", "<turn assistant>\n\\lok><audio 0></turn>\n", "<turn user>\n<document 0><image 2>as text</turn>\n", "<turn user>\n</turn>\n"]
    assert [r.expanded_tokens for r in out] == [5, 38, 1121, 0]
    assert [(a.placeholder, a.uri, a.tokens) for a in out[0].attachments] == [("<image 0>", "i1", 4), ("<image 1>", "i2", 1)]
    r = out[1]
    assert r.formatted[r.loss_start : r.loss_start + r.loss_length] == "\\lok><audio 0>" and out[0].loss_start == -1


def test_a_long_conversation_streams(spark):
    rows = [(5, i, "assistant" if i % 2 else "user", f"t{i}", None) for i in range(3000)]
    out = chat.read_back(chat.format_turns(turns(spark, rows[::-1]))).first()
    assert out.n_turns == 3000 and out.loss_sha256 == sha("".join(f"t{i}" for i in range(1, 3000, 2)))
