"""Spelling variants: words one edit apart, found by an even-partition pigeonhole join.

A word of length L is cut into two segments by its length alone: the first L // 2 code points and the rest. If two
words of length L differ in one place, they share one segment; if a word of length L + 1 has one code point more, it
holds the first segment at its place or the second one shifted by one. So every word is indexed under its own two
segments and probes those of words that are one shorter; candidates that share a segment are verified.

Where many words share a segment, what is left of them must hold the one edit, so the same rule is applied to the
rest: it is cut evenly again, by the length of the indexed word's rest. This goes on until few pairs share a key or
one code point is left, so no key's candidates grow with the vocabulary and none is dropped.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import dropped, id_and_text, stored

LETTERS = "[A-Za-zÀ-ÿ]"
#: A key whose indexed words make more pairs than this is cut once more. It changes cost only.
PAIRS = 1 << 12


def vocabulary(docs: DataFrame, least_length: int = 5, least_count: int = 3, thin: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): maximal runs of letters in whole texts, A-Z lower-cased, with their occurrences.

    With ``thin``, a run loses a code point where that number divides the crc32 of ``<id>:<run>``. Null texts have no
    words; a null id counts as empty. Only words of ``least_length`` code points and ``least_count`` occurrences stay.
    """
    found = F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0))  # shorter runs never count
    runs = id_and_text(docs, id_col, text_col).select("doc_id", F.explode(found).alias("run"))
    runs = runs.select("doc_id", F.translate("run", ascii_uppercase, ascii_lowercase).alias("run"))
    word: Column = F.col("run")
    if thin:
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
        runs = runs.select("run", h.alias("h"), F.char_length("run").alias("length"))
        at = (F.col("h") % F.col("length")).cast("int")
        cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.col("length")))
        word = F.when(F.col("h") % thin == 0, cut).otherwise(F.col("run"))
    counts = runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter((F.char_length("word") >= least_length) & (F.col("n") >= least_count))


def _cut(level: DataFrame) -> DataFrame:
    """Each row twice: under the first and the second segment of its rest, with what is then left of it.

    ``own`` rows are indexed words. The others are one longer and probe: their second segment starts one later.
    """
    rest, shift = F.col("rest"), F.when(F.col("own"), 0).otherwise(1)
    half = F.floor((F.char_length(rest) - shift) / 2).cast("int")
    length = F.char_length(rest)
    first = F.struct(F.xxhash64("key", F.lit(0), rest.substr(F.lit(1), half)).alias("key"), rest.substr(half + 1, length).alias("rest"))
    second = F.struct(F.xxhash64("key", F.lit(1), rest.substr(half + 1 + shift, length)).alias("key"), rest.substr(F.lit(1), half + shift).alias("rest"))
    return level.select("word", "n", "own", F.explode(F.array(first, second)).alias("s")).select("word", "n", "own", "s.*")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n) for every two words (word, n) that are exactly one edit apart, in both directions.

    ``words`` must be distinct. Keys are hashes; as whole words are verified, words whose keys collide do no harm.
    """
    whole = lambda own, length: words.select("word", "n", F.lit(own).alias("own"), F.xxhash64(length).alias("key"), F.col("word").alias("rest"))
    level, last, pairs = whole(True, F.char_length("word")).union(whole(False, F.char_length("word") - 1)), [], []
    while True:
        rows = _cut(level)
        sizes = rows.groupBy("key").agg(F.count_if("own").alias("owns"), F.count(F.lit(1)).alias("members"), F.max(F.when(F.col("own"), F.char_length("rest"))).alias("left"))
        sizes = sizes.filter((F.col("owns") >= 1) & (F.col("members") >= 2))
        hot = (F.col("owns") * F.col("members") > PAIRS) & (F.col("left") >= 2)
        rows = stored(rows.join(sizes.select("key", hot.alias("hot")), "key"), "segments")
        few = rows.filter(~F.col("hot"))
        a = few.filter("own").select("key", "word", "n")
        b = few.select("key", F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("own").alias("near_own"))
        candidate = (F.col("word") < F.col("near")) | ~F.col("near_own")
        met = a.join(b, "key").filter(candidate & (F.levenshtein("word", "near", 1) == 1))
        pairs.append(stored(met.select("word", "n", "near", "near_n"), "pairs"))
        dropped(*last)
        level, last = rows.filter("hot").drop("hot"), [rows]
        if level.isEmpty():
            break
    one = reduce(DataFrame.union, pairs).dropDuplicates(["word", "near"])  # a doubled letter at the cut meets twice
    near = stored(one.union(one.select("near", "near_n", "word", "n")), "near")
    dropped(*pairs, *last)
    return near


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last. Steps double, so k rounds follow 2**k of them."""
    reached = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        far = reached.select(F.col("word").alias("at"), F.col("root").alias("far"))
        further = stored(reached.join(far, F.col("root") == F.col("at"), "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        dropped(reached)
        reached = further.select("word", "root")
        if further.filter("moved").isEmpty():
            return reached


def spelling_variants(words: DataFrame, times: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of (word, n).

    n_near counts the words one edit apart. The form is the most frequent of these (ties: the smallest in code-point
    order), if it occurs at least ``times`` times as often; root follows forms to the last one. Words without near
    words or without a form have themselves as root and null forms; no words give no rows.
    """
    words = stored(words.select("word", "n"), "words")
    near = near_words(words)
    best = near.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("form"))).alias("best"))
    named = -F.col("best.order") >= times * F.col("n")
    best = stored(best.select("word", "n_near", F.when(named, F.col("best.form")).alias("form"), F.when(named, -F.col("best.order")).alias("form_n")), "forms")
    dropped(near)
    roots = _roots(best.filter(F.col("form").isNotNull()))
    joined = words.join(best, "word", "left").join(roots, "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
