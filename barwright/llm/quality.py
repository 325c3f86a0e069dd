"""Quality rules: how far a text's histograms are from those of its language.

Two histograms are compared with the language's by Jensen-Shannon distance (base 2, 0 to 1): classes
of characters, and common words. A distance counts only for texts long enough for it. The references
are the sums over all texts of the language in the table that pass the base rules (shortness,
repeated 3-word windows), if they are enough. The base rules fail a text whatever its distances.

DataFrame functions only, a row at a time; only sums by language are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.shared import SPACE, SPACE_CHARS, written

# Common words of the languages that have a reference.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he", "this", "are"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "nicht", "ein", "eine", "dem", "es", "im", "auch"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "plus", "pas", "au"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "es"),
}
#: Classes of characters; what is in none is a letter.
CLASSES = ("upper", "digit", "mark", "symbol", "space", "letter")

BASE_WORDS, REPEAT_PERCENT = 50, 50
#: Words from which a distance counts, and the distance above which a text fails.
CHAR_WORDS, CHAR_LIMIT = 50, 0.30
COMMON_WORDS, COMMON_LIMIT = 100, 0.30
#: Texts that pass the base rules from which a language has a reference: one text is then a small part of it.
LEAST_TEXTS = 20
_PLACE = 24


def _is(word: str):
    return lambda x: x == word


def _repeat_words(h: Column, packed: Column, exact: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more."""
    twice = F.filter(exact, lambda x, i: F.coalesce(x["h"] == F.get(exact, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(exact, i + 1)["h"], F.lit(False)))
    return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2))))).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts, and the histograms ``classes`` and ``common`` of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), text.alias("t"))
    bare = F.btrim("t", F.lit(SPACE_CHARS))
    d = d.withColumn("bare", bare).withColumn("words", F.when(F.col("bare") == "", F.array().cast("array<string>")).otherwise(F.split("bare", f"[{SPACE}]+")))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    d = d.withColumn("lines", lines)
    # what is not a lower-case ASCII letter is little; the classes are counted in it
    d = d.withColumn("odd", F.regexp_replace("t", "[a-z]+", ""))

    def count(pattern: str) -> Column:
        return F.length(F.regexp_replace("odd", f"[^{pattern}]+", ""))

    d = d.withColumns({"n_chars_": F.length("t"), "space": count(SPACE), "n_symbols": count(r"#*$%&|<>").cast("long"), "upper": count("A-Z"), "digit": count("0-9"), "mark": count(r"""!"'(),\-./:;?\[\]{}""")})
    d = d.withColumn("n_words", F.size("words").cast("long"))
    # a number for each 3-word window; equal ones are found by sorting hash and place in one number,
    # and told apart from chance by the whole hash
    h = F.transform("words", lambda x, i: F.xxhash64(x, F.get("words", i + 1), F.get("words", i + 2)))
    d = d.withColumn("h", F.when(F.col("n_words") < 3, F.array().cast("array<bigint>")).otherwise(F.slice(h, 1, F.greatest(F.size("words") - 2, F.lit(1)))))
    mask = (1 << _PLACE) - 1
    packed = F.sort_array(F.transform("h", lambda x, i: x.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long"))))
    d = d.withColumn("packed", packed)
    near = F.filter("packed", lambda x, i: F.coalesce(F.shiftright(x, _PLACE) == F.shiftright(F.get("packed", i - 1), _PLACE), F.lit(False)) | F.coalesce(F.shiftright(x, _PLACE) == F.shiftright(F.get("packed", i + 1), _PLACE), F.lit(False)))
    places = F.when(F.col("n_words") <= mask, F.transform(near, lambda x: x.bitwiseAND(F.lit(mask)).cast("int"))).otherwise(F.transform("h", lambda x, i: i))
    d = d.withColumn("exact", F.sort_array(F.transform(places, lambda p: F.struct(F.get("h", p).alias("h"), p.alias("p")))))
    every = sorted({v for words in COMMON.values() for w in words for v in (w, w.capitalize())})
    d = d.withColumn("found", F.transform(F.filter("words", lambda w: w.isin(every)), F.lower))
    common = F.array().cast("array<bigint>")
    for lang, words in COMMON.items():
        counts = [F.size(F.filter("found", _is(w))).cast("long") for w in words]
        common = F.when(F.col("lang") == lang, F.array(*counts)).otherwise(common)
    classes = [F.col("upper"), F.col("digit"), F.col("mark"), F.col("n_symbols"), F.col("space"), F.col("n_chars_") - F.col("upper") - F.col("digit") - F.col("mark") - F.col("n_symbols") - F.col("space")]
    return d.select(
        "doc_id",
        "lang",
        "n_words",
        (F.col("n_chars_") - F.col("space")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("h"), F.col("packed"), F.col("exact")).alias("n_repeat_words"),
        F.array(*[c.cast("long") for c in classes]).alias("classes"),
        common.alias("common"),
    )


def _plus_rest(counts: Column, all_: Column) -> Column:
    """The histogram with one more bin for what is in none."""
    return F.concat(counts, F.array(all_ - F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)))


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(0.0))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence, base 2, of two arrays of shares."""
    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    each = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / 2))


def judge(docs: DataFrame) -> DataFrame:
    """Counts, distances and verdict of every row.

    A null text is empty and fails for shortness; texts of any length are read whole. Languages
    without a list of common words or with under ``LEAST_TEXTS`` texts, and null, have no reference:
    only the base rules hold. Repeated and null doc_ids are rows of their own; an empty table gives
    none. Other columns are ignored.
    """
    m = written(measure(docs), "quality")
    base = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    known = m.where(F.col("lang").isin(*COMMON) & ~base)
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))] + [F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(20)]
    ref = known.groupBy("lang").agg(*sums, F.sum("n_words").alias("all_words"), F.count("*").alias("texts")).where(F.col("texts") >= LEAST_TEXTS)
    ref = ref.select(
        F.col("lang").alias("ref_lang"),
        _shares(F.array(*[f"c{i}" for i in range(len(CLASSES))])).alias("ref_classes"),
        _shares(_plus_rest(F.array(*[f"w{i}" for i in range(20)]), F.col("all_words"))).alias("ref_common"),
    )
    # one row for each language of COMMON at most
    j = m.join(F.broadcast(ref), m["lang"] == ref["ref_lang"], "left")
    j = j.withColumn("own_classes", _shares(F.col("classes"))).withColumn("own_common", _shares(_plus_rest(F.col("common"), F.col("n_words"))))
    j = j.withColumn("char_distance", F.when(F.col("ref_lang").isNotNull() & (F.col("n_words") >= CHAR_WORDS), js_distance(F.col("own_classes"), F.col("ref_classes"))))
    j = j.withColumn("common_distance", F.when(F.col("ref_lang").isNotNull() & (F.col("n_words") >= COMMON_WORDS), js_distance(F.col("own_common"), F.col("ref_common"))))
    far = F.coalesce(F.col("char_distance") > CHAR_LIMIT, F.lit(False)) | F.coalesce(F.col("common_distance") > COMMON_LIMIT, F.lit(False))
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ~far).alias("kept"), "lang", "char_distance", "common_distance")
