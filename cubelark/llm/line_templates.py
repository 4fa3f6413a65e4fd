"""Line dedup by a log-template tree; DataFrame operations only.

The tree has a fixed depth: a line's token count, then its leading tokens. Tokens
with a digit are variable fields from the start. In a leaf, a token's support is
the number of documents that have it at its position. A template has at least
MIN_CONSTANTS constants and MIN_SHARE of its tokens, so that many of a line's best
supported tokens are constant, and so is every token with at least CONSTANT_SHARE of
the least support among those; others are variable fields, however many documents
the leaf has. What remains constant is the line's template. A template with enough constants
that occurs in enough documents recurs: its first line (smallest doc_id, then line
number) stays and every other one is dropped. The first stays because dropping it
too would erase all of a group of copied documents.

A line that stands unchanged in EXACT_DOCS documents recurs as well, with all of its
tokens as they are; lines too short for a template recur in no other way.

Only lines whose leaf or whole line recurs are shuffled. Both are found from hashes;
a bounded Bloom bitmap of them lets the scan pass over all other lines. Documents,
leaves, lines and templates are told apart by two 64-bit hashes each.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom_bits import bitmap, bits_for, keep_possible, positions
from .store import durable, join_hot, unused, written

#: Leading tokens that lead to a leaf.
LEADING = 3
#: Documents in which a template recurs, and that a constant token has at least.
MIN_DOCS = 5
#: Documents in which an unchanged line recurs.
EXACT_DOCS = 2
#: Constants that a recurring template has at least, and their least share of its tokens.
MIN_CONSTANTS, MIN_SHARE = 4, 0.5
#: Support of a constant, as a share of the least support among a line's MIN_CONSTANTS (or MIN_SHARE) best supported tokens.
CONSTANT_SHARE = 0.5
#: Fixed value: what stands for a variable field.
FIELD = "<*>"


def _flat(line: Column) -> Column:
    """Single spaces between tokens; the pattern runs only where a plain search has found something to replace."""
    odd = reduce(operator.or_, [F.contains(line, F.lit(x)) for x in ("  ", "\t", "\r", "\x0b", "\x0c")])
    return F.btrim(F.when(odd, F.regexp_replace(line, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(line), F.lit(" "))


def _id(*columns: Column | str) -> Column:
    """128 bits that stand for the columns' values."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))


def _lines(docs: DataFrame, min_docs: int, shortest: int) -> DataFrame:
    """(doc, doc_id, line_no, key, line, need): each line's leaf, and the line itself, as keys that recur in `need` documents.

    `doc` names a document's content. Tokens with a digit are variable fields in
    `line`, which is null beside the key of the line itself. Blank lines, lines of fewer than
    `shortest` tokens and leaves of fewer than MIN_CONSTANTS have no row. explode(array(x)) keeps x, a pattern
    over all the text, from being computed again in the filters that follow.
    """
    own = docs.select(_id("doc_id", "text").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "raw"))
    own = own.select("doc", "doc_id", "line_no", F.explode(F.array(_flat(F.col("raw")))).alias("flat"))
    count = F.length("flat") - F.length(F.replace("flat", F.lit(" "), F.lit(""))) + 1
    own = own.where((F.col("flat") != "") & (count >= shortest))
    line = F.when(F.col("flat").rlike("[0-9]"), F.regexp_replace("flat", r"[^ ]*[0-9][^ ]*", FIELD)).otherwise(F.col("flat"))
    own = own.select("doc", "doc_id", "line_no", line.alias("line"), count.alias("count"), _id(F.lit("line"), "flat").alias("whole"))
    leaf = F.struct(_id("count", F.substring_index("line", " ", LEADING)).alias("key"), F.col("line").alias("line"), F.lit(min_docs).alias("need"))
    whole = F.struct(F.col("whole").alias("key"), F.lit(None).cast("string").alias("line"), F.lit(EXACT_DOCS).alias("need"))
    keys = F.when(F.col("count") >= MIN_CONSTANTS, F.array(leaf, whole)).otherwise(F.array(whole))
    return own.select("doc", "doc_id", "line_no", F.explode(keys).alias("k")).select("doc", "doc_id", "line_no", "k.*")


def _shapes(some: DataFrame, min_docs: int) -> DataFrame:
    """(line_id, template, docs) of the lines (line_id, leaf, line, doc) that have a template; docs counts the line's documents."""
    # Tokens' support within their leaf, from each distinct line once with its number of documents.
    once = some.select("line_id", "leaf", "line", "doc").distinct().groupBy("line_id", "leaf", "line").agg(F.count("*").alias("docs"))
    tokens = once.select("line_id", "leaf", "docs", F.posexplode(F.split("line", " ")).alias("pos", "token"))
    tokens = written(tokens.select("line_id", "docs", "pos", "token", _id("leaf", "pos", "token").alias("slot")))
    constant = tokens.where(F.col("token") != FIELD).groupBy("slot").agg(F.sum("docs").alias("support"), F.count("*").alias("n")).where(F.col("support") >= min_docs)
    marked = join_hot(tokens, written(constant), "slot", "n", "left").select("line_id", "docs", "pos", "token", "support")
    shapes = marked.groupBy("line_id").agg(F.first("docs").alias("docs"), F.sort_array(F.collect_list("support"), asc=False).alias("best"), F.array_sort(F.collect_list(F.struct("pos", "token", "support"))).alias("parts"))
    shapes = shapes.withColumn("least", F.greatest(F.lit(MIN_CONSTANTS), F.ceil(MIN_SHARE * F.size("parts"))).cast("int")).where(F.size("best") >= F.col("least"))
    floor = CONSTANT_SHARE * F.element_at("best", F.col("least"))
    shape = F.transform("parts", lambda p: F.when(p["support"] >= floor, p["token"]).otherwise(F.lit(FIELD)))
    return shapes.select("line_id", _id(shape).alias("template"), "docs")


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, shortest: int = 1) -> DataFrame:
    """(doc, line_no) of the lines to drop."""
    lines = _lines(docs, min_docs, shortest)
    pairs = lines.select("key", "need", "doc").distinct()
    keys = durable(pairs.groupBy("key", "need").count().where(F.col("count") >= F.col("need")).select("key", F.col("count").alias("n")))
    bits = bits_for(keys.count())
    at = keys.select(F.explode(F.array(*positions(F.col("key"), bits))).alias("p"))
    held = written(keep_possible(lines, bitmap(at, "p"), F.col("key"), bits).where("_maybe").drop("_maybe"))
    held = written(join_hot(held, keys, "key", "n"))
    some = held.where("line is not null").withColumnRenamed("key", "leaf").withColumn("line_id", _id("leaf", "line"))

    place = ["need", "doc", "doc_id", "line_no"]
    fit = join_hot(some.select("line_id", *place), written(_shapes(some, min_docs)), "line_id", "docs").select("template", *place)
    fit = written(fit.union(held.where("line is null").select("key", *place)))
    heads = fit.groupBy("template", "need", "doc").agg(F.min(F.struct("doc_id", "doc", "line_no")).alias("first")).groupBy("template", "need")
    heads = heads.agg(F.count("*").alias("docs"), F.min("first").alias("first")).where(F.col("docs") >= F.col("need")).drop("need")
    gone = join_hot(fit, written(heads), "template", "docs").where((F.col("doc") != F.col("first.doc")) | (F.col("line_no") != F.col("first.line_no")))
    return gone.select("doc", "line_no").distinct()


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, shortest: int = 1) -> DataFrame:
    """`docs` with its recurring lines taken out of `text`, and _lines and _dropped, their numbers.

    All rows and columns stay; a text whose lines all go becomes empty. Null texts
    stay null. Rows that repeat a document (doc_id and text) count as one and are
    treated alike; rows of one doc_id with several texts are several documents. Null
    doc_ids are one doc_id. Blank lines, and lines of fewer than `shortest` tokens, always stay.
    An empty table gives an empty table. Columns `_lines` and `_dropped` of the input are
    replaced; all others may have any name.
    """
    doc, own, gone_lines = (unused(docs, x) for x in ("doc", "own", "gone"))
    gone = dropped_lines(docs, min_docs, shortest).groupBy(F.col("doc").alias(doc)).agg(F.collect_list("line_no").alias(gone_lines))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    out = docs.withColumn(own, _id("doc_id", "text")).join(gone, F.col(own) == F.col(doc), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone_lines))  # in order, by a hash set
    # A lambda's own variable holds the split text, so that it isn't split again for each line.
    both = F.array(F.struct(lines.alias("lines"), stay.alias("stay")))
    kept = F.transform(both, lambda x: F.array_join(F.transform(x["stay"], lambda i: F.get(x["lines"], i)), "\n"))[0]
    text = F.when(F.col(gone_lines).isNull(), F.col("text")).otherwise(kept)
    columns = [text.alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in ("_lines", "_dropped")]
    dropped = F.when(F.col(gone_lines).isNull(), 0).otherwise(F.size(gone_lines)).cast("long")
    return out.select(*columns, F.size(lines).cast("long").alias("_lines"), dropped.alias("_dropped"))
