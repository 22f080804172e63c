"""Commands and shared files in a table of chat messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleansheet.functions.text import trimmed

# The command words.
COMMANDS = ("explain", "clean", "generate", "optimize", "validate")
_COMMAND = f"(?is)^({'|'.join(COMMANDS)})(.*)$"


def parse_commands(messages: DataFrame, text: str = "text") -> DataFrame:
    """Messages that start with a command word once mentions are removed.

    The word needs no boundary after it. A command without argument is kept
    and marked as lacking input.
    """
    return (
        messages.withColumn("_said", trimmed(F.regexp_replace(text, "<@[^>]+>", "")))
        .where(F.col("_said").rlike(_COMMAND))
        .withColumn("command", F.lower(F.regexp_extract("_said", _COMMAND, 1)))
        .withColumn("argument", trimmed(F.regexp_extract("_said", _COMMAND, 2)))
        .withColumn("missing_input", F.col("argument") == "")
        .drop("_said")
    )


def csv_shares(messages: DataFrame) -> DataFrame:
    """File-share messages with at least one CSV file, and the first such file."""
    csv_files = F.filter("files", lambda f: F.lower(f["name"]).endswith(".csv"))
    return (
        messages.where(F.col("subtype") == "file_share")
        .withColumn("_file", F.get(csv_files, F.lit(0)))
        .where(F.col("_file").isNotNull())
        .withColumn("file_name", F.col("_file.name"))
        .withColumn("file_url", F.col("_file.url_private_download"))
        .drop("_file", "files")
    )
