"""Deleting repeated runs of lines, found by winnowing over line hashes.

A document is the sequence of its lines that hold a word. A window is a shortest run of lines from
a line on with at least min_words words. The least line hash of a window is selected; selected
positions are the document's fingerprints, far fewer than its windows. Two places that share a run
of that many words share a window, and so a fingerprint at the same place in it.

Fingerprints meet by hash, once for the whole corpus. Only positions whose hash is selected
elsewhere too are followed: around them the windows seen from their first line reach a repeated
run's left edge, and the shortest runs seen from their last line its right edge, so that together
they extend a match both ways to exactly the lines of the repeated run. These windows meet by
their whole content; every occurrence but the first one is a repeat. Nothing meets in pairs, so a
line or passage that a third of all documents share costs one row an occurrence, and joins on
fingerprints and contents are salted.

Only DataFrame functions are used; all work in a document is linear in its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, cut, has_columns, n_words

#: Column names of the operator's own frames.
DOC, ROW = "run_doc", "run_row"
#: Tasks that rows of one hot fingerprint or content are spread over.
SALTS = 16


def _split(text: Column) -> Column:
    """All lines without the blanks around them; a line without a word is empty."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(BLANKS)))


def _lines(text: Column) -> Column:
    """Lines with a word: place in the text (from 0), two hashes of the trimmed line, words."""
    return F.transform(
        F.filter(F.transform(_split(text), lambda x, i: F.struct(i.alias("at"), x.alias("line"))), lambda x: x["line"] != ""),
        lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x["line"]).alias("a"), F.xxhash64(F.lit(1), x["line"]).alias("b"), n_words(x["line"]).cast("int").alias("n")),
    )


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once: lambdas inside body may use it for every item."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _reach(words: Column, start: Column, min_words: int) -> Column:
    """How many items of words from start (1, 2, ...) on make min_words; null where all of them do not.

    Every item is 1 at least, so min_words items are enough to look at.
    """
    seen = F.aggregate(
        F.slice(words, start, F.lit(min_words)),
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("k")),
        lambda acc, n: F.when(acc["sum"] >= min_words, acc).otherwise(F.struct((acc["sum"] + n).alias("sum"), (acc["k"] + 1).alias("k"))),
    )
    return F.when(F.element_at(words, start) >= min_words, 1).otherwise(_let(seen, lambda x: F.when(x["sum"] >= min_words, x["k"])))


def _documents(docs: DataFrame, min_words: int) -> DataFrame:
    """Documents of min_words words or more as arrays over their lines: a and b (hashes), ahead and back (lines of the window that begins or ends there) and least (place of the least a of the window that begins there); places count from 1."""
    lines = docs.select(F.col("doc_id").alias(DOC), F.xxhash64("text").alias(ROW), _lines(F.col("text")).alias("lines"))

    def measured(x: Column) -> Column:
        place = F.sequence(F.lit(1), F.size(x["n"]))
        ahead = F.transform(place, lambda i: _reach(x["n"], i, min_words))
        back = _let(F.reverse(x["n"]), lambda n: F.transform(place, lambda i: _reach(n, F.size(n) - i + 1, min_words)))
        return F.struct(x["a"].alias("a"), x["b"].alias("b"), ahead.alias("ahead"), back.alias("back"))

    def least(x: Column) -> Column:
        first = lambda k, size: _let(F.slice(x["a"], k + 1, size), lambda part: k + F.array_position(part, F.array_min(part)).cast("int"))
        places = F.transform(x["ahead"], lambda size, k: F.when(size.isNotNull(), first(k, size)))
        return F.struct(x["a"].alias("a"), x["b"].alias("b"), x["ahead"].alias("ahead"), x["back"].alias("back"), places.alias("least"))

    long = F.aggregate("lines", F.lit(0).cast("long"), lambda s, x: s + x["n"]) >= min_words
    arrays = _let(F.struct(F.col("lines.a").alias("a"), F.col("lines.b").alias("b"), F.col("lines.n").alias("n")), lambda x: _let(measured(x), least))
    return lines.where(long).select(DOC, ROW, arrays.alias("x")).select(DOC, ROW, "x.*")


def _salted(many: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """many with the columns of few, which has one row a key: rows of a hot key spread over SALTS tasks."""
    left = many.withColumn("salt", F.pmod(F.xxhash64(F.lit(5), *many.columns), F.lit(SALTS)))
    right = few.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return left.join(right, [*keys, "salt"]).drop("salt")


def shared_positions(documents: DataFrame) -> DataFrame:
    """One row per document with a fingerprint that is selected elsewhere too: DOC, ROW and places (of its shared fingerprints, sorted)."""
    picked = documents.select(DOC, ROW, "a", F.explode(F.array_distinct(F.filter("least", lambda p: p.isNotNull()))).alias("place"))
    picked = picked.select(DOC, ROW, "place", F.element_at("a", F.col("place")).alias("print"))
    shared = picked.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("print")
    return _salted(picked, shared, ["print"]).groupBy(DOC, ROW).agg(F.array_sort(F.collect_set("place")).alias("places"))


def windows(documents: DataFrame, shared: DataFrame, min_words: int) -> DataFrame:
    """Windows around shared fingerprints: DOC, ROW, first (line, from 1), size, a and b (content)."""
    shared = shared.withColumnsRenamed({DOC: "shared_doc", ROW: "shared_row"})
    met = documents.join(shared, F.col(DOC).eqNullSafe(F.col("shared_doc")) & (F.col(ROW) == F.col("shared_row")))
    base = min_words + 1  # sizes are at most min_words
    # For every line whether it is a shared fingerprint, built from the gaps between these.
    gaps = F.transform("places", lambda p, k: F.concat(F.array_repeat(F.lit(False), p - F.when(k > 0, F.element_at("places", F.greatest(k, F.lit(1)))).otherwise(0) - 1), F.array(F.lit(True))))
    marks = F.concat(F.flatten(gaps), F.array_repeat(F.lit(False), F.size("a") - F.element_at("places", -1)))

    def codes(mark: Column) -> Column:
        chosen = lambda first, size: F.when(F.element_at(mark, F.element_at("least", first)), first.cast("long") * base + size)
        ahead = F.transform("ahead", lambda size, k: F.when(size.isNotNull(), chosen(k + 1, size)))
        back = F.transform("back", lambda size, k: F.when(size.isNotNull(), chosen(k + 2 - F.coalesce(size, F.lit(1)), size)))
        return F.array_distinct(F.filter(F.concat(ahead, back), lambda c: c.isNotNull()))

    rows = met.select(DOC, ROW, "a", "b", F.explode(_let(marks, codes)).alias("code"))
    rows = rows.select(DOC, ROW, "a", "b", F.call_function("div", F.col("code"), F.lit(base)).cast("int").alias("first"), F.pmod("code", F.lit(base)).cast("int").alias("size"))
    part = lambda c: F.xxhash64(F.slice(c, F.col("first"), F.col("size"))).alias(c)
    return rows.select(DOC, ROW, "first", "size", part("a"), part("b"))


def repeated_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """One row per document that has repeated runs: doc_id, run_row (hash of the text), indexes (of the lines to delete among those with a word, from 1).

    See dedup_lines for what is repeated.
    """
    documents = cut(_documents(docs, min_words))
    met = cut(windows(documents, shared_positions(documents), min_words))
    place, content = F.struct(F.col(DOC), F.col(ROW), F.col("first")), ["a", "b", "size"]
    origins = met.groupBy(*content).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("origin")).where("n > 1").drop("n")
    later = _salted(met, origins, content).where(place > F.col("origin"))
    # Overlapping windows of one document: its lines once each.
    spans = later.groupBy(DOC, ROW).agg(F.collect_set(F.struct("first", "size")).alias("spans"))
    indexes = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["first"] + s["size"] - 1))))
    return spans.select(F.col(DOC).alias("doc_id"), F.col(ROW), F.array_sort(indexes).alias("indexes"))


def dedup_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """All rows and columns of docs, text without repeated runs, with lines_total, lines_gone and gone_lines.

    Needs doc_id and text. A run of consecutive lines (lines without a word do not count, and
    blanks around a line do not either) with at least min_words words that occurs earlier, in a
    document that comes before by (doc_id, text hash; null ids first) or further up in the same
    one, is deleted wherever it lies in a longer run or not; the first occurrence stays. A line is
    deleted iff some such run holds it. Lines without a word always stay. lines_total: lines with
    a word; lines_gone: how many of them are deleted; gone_lines: their places in the text, from 0.

    A null text stays null with 0 lines. Rows equal in doc_id and text are one document and lose
    the same lines. An empty table gives an empty table. Existing columns of the added names are
    replaced.
    """
    has_columns(docs, "doc_id", "text")
    own = ["lines_total", "lines_gone", "gone_lines"]
    gone = repeated_lines(docs, min_words).withColumnsRenamed({"doc_id": "run_gone_doc", ROW: "run_gone_row", "indexes": "run_gone"})
    keyed = docs.withColumn("run_hash", F.xxhash64("text"))
    both = keyed.join(gone, (F.col("run_hash") == F.col("run_gone_row")) & F.col("doc_id").eqNullSafe(F.col("run_gone_doc")), "left")
    split = _split(F.col("text"))
    worded = F.filter(F.transform(split, lambda x, i: F.when(x != "", i)), lambda i: i.isNotNull())
    places = _let(worded, lambda w: F.struct(F.greatest(F.size(w), F.lit(0)).alias("n"), F.transform("run_gone", lambda k: F.element_at(w, k)).alias("gone")))
    both = both.withColumn("run_places", F.when(F.col("text").isNotNull(), places))
    gone_lines = F.coalesce("run_places.gone", F.array().cast("array<int>"))

    def without(x: Column) -> Column:
        """The lines of x.lines but for those whose index is in x.gone."""
        kept = F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), x["gone"])
        return F.array_join(F.transform(kept, lambda i: F.element_at(x["lines"], i + 1)), "\n")

    rest = _let(F.struct(F.split("text", "\n", -1).alias("lines"), gone_lines.alias("gone")), without)
    both = both.withColumns({
        "lines_total": F.coalesce("run_places.n", F.lit(0)), "lines_gone": F.size(gone_lines), "gone_lines": gone_lines,
        "text": F.when(F.col("run_gone").isNotNull(), rest).otherwise(F.col("text")),
    })
    return both.select(*[c for c in docs.columns if c not in own], *own)


def drop_emptied(deduplicated: DataFrame) -> DataFrame:
    """The rows of dedup_lines' result but for those that lost lines and have no word left, without its added columns."""
    own = [c for c in deduplicated.columns if c not in ("lines_total", "lines_gone", "gone_lines")]
    return deduplicated.where("lines_gone = 0 or lines_gone < lines_total").select(*own)
