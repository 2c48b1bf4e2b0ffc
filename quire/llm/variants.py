"""Spelling variants by bands of letter parities.

A word's mask holds for each letter whether it occurs an odd number of times. One edit flips at most two bits: of three
bands of letters a replaced letter leaves one as it is, an inserted letter two. Words join where such bands are equal and
their lengths fit; masks that differ in at most two bits are verified letter by letter.

What is equal in a band is more than its parities: the letters of an untouched band stand in the same order, and after a
replacement in the same places. The join's keys hold that too. A key with more than dense words is split by the place of
the edit: it lies in one half of the word, so the other half is equal and becomes part of the key; halves are halved
again until a key is small or its words differ in one place only. So no word meets more than a bounded number of others,
however many words there are, and no pair is lost.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Letters of words, of which only A-Z are lower-cased.
LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters are dealt to the bands in turn, frequent ones first, so that each band tells about as much of a word.
FREQUENT = "etaonirshdlcumwfgpybvkjxqz"
BANDS = tuple("".join((FREQUENT + "".join(map(chr, range(0xC0, 0x100))))[i::3]) for i in range(3))


def _lowered(c):
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def word_counts(docs: DataFrame, least_letters: int = 7, least_count: int = 2, slip: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of the runs of letters in the texts, lower-cased in A-Z, that have so many letters and occurrences.

    slip: where it divides the crc32 of "key:run", the letter at that number modulo the run's length is left out, and
    what is left is the word: a known rate of misspellings, the same for the same text. Null texts have no words; a
    null key stands as an empty one; repeated rows count each for itself; an empty table gives no words. Other columns
    are not read.
    """
    found = F.regexp_extract_all(F.col(text).cast("string"), F.lit(f"[{LETTERS}]{{{least_letters},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.explode(found).alias("run")).select("k", _lowered(F.col("run")).alias("word"))
    if slip:
        h = F.crc32(F.concat("k", F.lit(":"), "word").cast("binary"))
        rows = rows.withColumn("h", h).withColumn("at", (F.col("h") % F.length("word")).cast("int"))
        without = F.concat(F.expr("substring(word, 1, at)"), F.expr("substring(word, at + 2)"))
        rows = rows.select(F.when(F.col("h") % slip == 0, without).otherwise(F.col("word")).alias("word")).where(F.length("word") >= least_letters)
    return rows.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _mask(band: str) -> F.Column:
    return F.expr(f"aggregate(letters, 0, (m, c) -> if(instr('{band}', c) > 0, m ^ shiftleft(1, instr('{band}', c) - 1), m))")


def _entries(words: DataFrame) -> DataFrame:
    """(key, role, word, n, m0, m1, m2, a, b): where a word stands, and the window [a, b) in which the edit is.

    role 0: either word of a replacement; 1: the shorter and 2: the longer word of an insertion. A window counts the
    shorter word's places, before which a letter may be inserted, or the places of a replacement.
    """
    w = words.withColumn("letters", F.expr("filter(split(word, ''), c -> c <> '')"))
    w = w.select("word", "n", F.length("word").alias("len"), *[_mask(band).alias(f"m{i}") for i, band in enumerate(BANDS)])
    options = []
    for i, band in enumerate(BANDS):
        places = F.regexp_replace("word", f"[^{band}]", ".")
        options.append(F.struct(F.xxhash64(F.lit(i), F.col(f"m{i}"), F.col("len"), places).alias("key"), F.lit(0).alias("role"), F.lit(0).alias("a"), F.col("len").alias("b")))
        j = (i + 1) % 3
        order = F.regexp_replace("word", f"[^{band}{BANDS[j]}]", "")
        for role in (1, 2):
            shorter = F.col("len") - (role - 1)
            options.append(F.struct(F.xxhash64(F.lit(3 + i), F.col(f"m{i}"), F.col(f"m{j}"), shorter, order).alias("key"), F.lit(role).alias("role"), F.lit(0).alias("a"), (shorter + 1).alias("b")))
    return w.select("word", "n", "m0", "m1", "m2", F.explode(F.array(*options)).alias("e")).select("e.key", "e.role", "word", "n", "m0", "m1", "m2", "e.a", "e.b")


def _met(entries: DataFrame) -> DataFrame:
    """Pairs of words that stand together under a key and are one edit apart."""
    x, y = (entries.select("key", *[F.col(c).alias(f"{c}{side}") for c in ("role", "word", "n", "m0", "m1", "m2")]) for side in "xy")
    flipped = reduce(lambda p, q: p + q, [F.bit_count(F.col(f"m{i}x").bitwiseXOR(F.col(f"m{i}y"))) for i in range(3)])
    roles = ((F.col("rolex") == 0) & (F.col("roley") == 0) & (F.col("wordx") < F.col("wordy"))) | ((F.col("rolex") == 1) & (F.col("roley") == 2))
    fits = roles & (flipped <= 2) & (F.levenshtein("wordx", "wordy", 1) == 1)
    # the condition is the join's own: what does not fit is never a row
    return x.join(y, (x["key"] == y["key"]) & fits).select("wordx", "nx", "wordy", "ny")


def _split(entries: DataFrame) -> DataFrame:
    """Entries of full keys under finer ones: the edit lies before or behind the middle of the window, the other part is equal."""
    m = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    e = entries.withColumns({"m": m, "off": F.when(F.col("role") == 1, 1).otherwise(0)})
    head = F.struct(F.xxhash64("key", F.lit("head"), F.expr("substring(word, a + 1, m - a)")).alias("key"), F.col("m").alias("a"), F.col("b"))
    tail = F.struct(F.xxhash64("key", F.lit("tail"), F.expr("substring(word, m - off + 1, b - m)")).alias("key"), F.col("a"), F.col("m").alias("b"))
    e = e.withColumn("e", F.explode(F.array(head, tail)))
    return e.select("e.key", "role", "word", "n", "m0", "m1", "m2", "e.a", "e.b")


def near_words(words: DataFrame, dense: int = 100) -> DataFrame:
    """(wordx, nx, wordy, ny): each pair of words (word, n; distinct) that differ by one inserted, deleted or replaced letter, once."""
    # written, as each round reads it several times
    entries, found = shared.save(_entries(words), "variant-entries"), []
    while True:
        full = entries.where("b - a > 1").groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > dense).select("key")
        full = shared.save(full, "variant-keys")  # written, so that its size is known where it is joined
        found.append(shared.save(_met(entries.join(full, "key", "left_anti")), "variant-pairs"))
        if full.isEmpty():
            break
        before = entries
        entries = shared.save(_split(entries.join(full, "key", "left_semi")), "variant-entries")
        shared.drop(before)
    return reduce(DataFrame.unionByName, found).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form; each round doubles the steps that are followed."""
    now = shared.save(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "variant-roots")
    while not now.where("moved").isEmpty():
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        after = shared.save(after, "variant-roots")
        shared.drop(now)
        now = after
    return now.select("word", "root")


def variants(words: DataFrame, ratio: int = 10, dense: int = 100) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for words (word, n).

    Near words differ by exactly one inserted, deleted or replaced code point. A word's form is its near word of largest
    n (ties: smallest in code-point order), if that is at least ratio times its own n, else null; root is where its
    forms end, itself if it has none. n_near counts its near words. Rows of one word are added up; null words and
    counts are left out; an empty table gives an empty one. Letters outside the bands' alphabets belong to no band and
    lose nothing by it. Other columns are not read.
    """
    words = shared.save(words.where("word is not null and n is not null").groupBy(F.col("word").cast("string").alias("word")).agg(F.sum("n").cast("long").alias("n")), "variant-words")
    pairs = near_words(words, dense)
    both = pairs.select(F.col("wordx").alias("word"), F.col("wordy").alias("other"), F.col("ny").alias("m"))
    both = both.unionByName(pairs.select(F.col("wordy").alias("word"), F.col("wordx").alias("other"), F.col("nx").alias("m")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    held = words.join(best, "word", "left")
    far = -F.col("best.m") >= ratio * F.col("n")
    held = held.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("best.other")).alias("form"), F.when(far, -F.col("best.m")).alias("form_n"))
    held = shared.save(held, "variant-forms")
    roots = _roots(held.where("form is not null"))
    return held.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
