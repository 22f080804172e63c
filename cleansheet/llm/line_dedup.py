"""Line deduplication with range-partitioned hashes; per-document keep bitmaps instead of texts.

Every step is a DataFrame operation. Lines travel as two 64-bit hashes with
their document and position. The hashes are range-partitioned together with
the document, so a line that a third of the corpus shares is spread over many
partitions, and sorted by document and position inside each partition. A
partition folds its run of equal hashes to one row (first occurrence and
number of documents) before the rows of a hash meet. Only lines that go are
sent back to their documents, as a bitmap of 64-line words in compressed form:
blocks that lose nothing are skipped and equal words in a row are counted.

A document is a row; rows that agree in both id and text are copies of one
document, count once, and each gets its bitmap. Null ids are ids like any
other. A null or empty text is one empty line.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, fresh, stored

MIN_DOCS = 10
MIN_CHARS = 1


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at both ends and with A-Z in lower case; other letters stay as they are."""
    bare = F.btrim(line, F.lit(WHITESPACE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(
        F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def version(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def hashed_lines(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """(doc, version, pos, h1, h2) for every line whose key has enough code points."""
    exploded = docs.select(
        F.col(doc_id).alias("doc"), version(F.col(text)).alias("version"),
        F.posexplode(lines(F.col(text))).alias("pos", "line"))
    keyed = exploded.select("doc", "version", "pos", line_key(F.col("line")).alias("key"))
    return keyed.where(F.char_length("key") >= min_chars).select(
        "doc", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit(1)).alias("h2"))


def keep_bitmaps(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS,
                 min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """One row for each document that loses lines: (doc, version, n_dropped, keep).

    Lines are equal when their keys are. A line found in at least `min_docs`
    documents goes everywhere, or, with `keep_first`, everywhere but at its
    first occurrence by document and position (with `min_docs=1` a repeat
    inside one document goes too). `keep` is a bitmap of lines in 64-line words
    whose bit i says that line i of the block stays, as runs (skip, words,
    word): `skip` blocks stay whole, then `words` blocks have that word. It
    ends with the last block that loses a line; `bitmap` writes it out.
    """
    hashed = stored(hashed_lines(docs, doc_id, text, min_chars), "line-hashes")
    run = ["h1", "h2", "doc", "version"]
    ranged = hashed.repartitionByRange(*run).sortWithinPartitions(*run, "pos")
    per_doc = ranged.groupBy(*run).agg(F.min("pos").alias("first"), F.collect_list("pos").alias("places"))
    keys = per_doc.groupBy("h1", "h2").agg(
        F.count("*").alias("docs"), F.min(F.struct("doc", "version", "first")).alias("head"))
    # Written, so that the join meets two plain exchanges, of which Spark splits the parts of a line that many share.
    gone = stored(keys.where(F.col("docs") >= min_docs), "line-keys")
    going = per_doc.join(gone, ["h1", "h2"]).select(
        "doc", "version", "head", F.explode("places").alias("pos"))
    if keep_first:
        at = F.struct("doc", "version", F.col("pos").alias("first"))
        going = going.where(~at.eqNullSafe(F.col("head")))
    bit = F.expr("shiftleft(1L, pos % 64)")
    blocks = going.groupBy("doc", "version", F.expr("cast(pos div 64 as int)").alias("block")).agg(
        F.bit_or(bit).alias("gone"))
    sparse = blocks.groupBy("doc", "version").agg(
        F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("block", "gone"))).alias("blocks"))
    end = F.size("blocks")
    before = lambda i: F.get("blocks", i - 1)
    at = lambda i: F.get("blocks", i)
    heads = F.filter(F.sequence(F.lit(0), end - 1), lambda i: ~F.coalesce(
        (before(i)["block"] + 1 == at(i)["block"]) & (before(i)["gone"] == at(i)["gone"]), F.lit(False)))
    runs = F.transform("heads", lambda i, run: F.struct(
        (at(i)["block"] - F.coalesce(before(i)["block"] + 1, F.lit(0))).alias("skip"),
        (F.coalesce(F.get("heads", run + 1), end) - i).alias("words"),
        F.bitwise_not(at(i)["gone"]).alias("word")))
    return sparse.withColumn("heads", heads).select("doc", "version", "n_dropped", runs.alias("keep"))


def bitmap(keep: Column) -> Column:
    """The words of a compressed bitmap, one per block of 64 lines."""
    return F.flatten(F.transform(keep, lambda run: F.concat(
        F.array_repeat(F.lit(-1).cast("long"), run["skip"]), F.array_repeat(run["word"], run["words"]))))


def drop_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **rules) -> DataFrame:
    """The documents with their remaining lines, all columns kept, plus `n_lines` and `n_dropped`.

    The two counts replace columns of these names. A null text comes out as an
    empty one.
    """
    maps = keep_bitmaps(docs, doc_id=doc_id, text=text, **rules)
    names = [fresh(docs.columns, n) for n in ("ld_doc", "ld_version", "ld_dropped", "ld_keep", "ld_own")]
    doc, of, dropped, keep, own = names
    maps = maps.toDF(doc, of, dropped, keep)
    tagged = docs.withColumn(own, version(F.col(text)))
    both = tagged.join(maps, F.col(own).eqNullSafe(F.col(of)) & F.col(doc_id).eqNullSafe(F.col(doc)), "left")
    all_lines = lines(F.col(text))
    # An array of one makes the words of a document a value that its lines share.
    stays = F.get(F.transform(F.array(bitmap(F.col(keep))), lambda words: F.filter(all_lines, lambda _, i: F.coalesce(
        F.get(words, F.floor(i / 64).cast("int")).bitwiseAND(_one_bit(i)) != 0, F.lit(True)))), 0)
    kept = F.when(F.col(keep).isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(stays, "\n"))
    return both.withColumns({
        "n_lines": F.size(all_lines).cast("long"), "n_dropped": F.coalesce(F.col(dropped), F.lit(0).cast("long")),
        text: kept}).drop(*names)


def _one_bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i % 64)
