"""Settings of a count."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class EngineConfig:
    default_model: str = "gpt-5.6-sol"
    status_display: str = "both"
    ignore_gitignored_files: bool = True
    enable_project_scan: bool = True
    download_tokenizers: bool = True

    @classmethod
    def from_session(cls, spark: SparkSession, prefix: str = "spark.tokenloom.") -> EngineConfig:
        """Each setting from the session, by its name behind the prefix, else its default."""
        values = {}
        for name, default in cls().__dict__.items():
            given = spark.conf.get(prefix + name, None)
            if given is not None:
                values[name] = given.lower() == "true" if isinstance(default, bool) else given
        return cls(**values)

    def shown(self, has_file: bool, has_project: bool) -> tuple[bool, bool]:
        """Whether the file's and the project's count are shown. With project scans off, a display
        of the project alone shows the file instead."""
        mode = "file" if self.status_display == "project" and not self.enable_project_scan else self.status_display
        project = self.enable_project_scan and has_project and mode != "file"
        return has_file and not (mode == "project" and project), project
