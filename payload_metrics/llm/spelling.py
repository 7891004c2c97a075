"""Groups spelling variants: words one edit apart, found by pivotal grams.

A word's bigrams, with their positions, are ordered from rare to frequent among all words. Its prefix
is the first three of them and all that equal the third. By dynamic programming, the two disjoint
bigrams of least total frequency in the prefix become its pivots. One edit spoils at most one of two
disjoint pivots. So if two words are one edit apart, the word whose prefix ends at the rarer bigram
has a pivot that stands unspoilt in the prefix of the other. The edit lies on one side of it, and
then the other side is equal: all up to the pivot, which fixes its position from the start, or all
from it on, which fixes its position from the end. Pivots and prefix entries meet by equality of that
side and of the length, which differs by one at most. Every pair that meets is verified; pairs whose
sets of letters differ by more than one edit can change are out before their distance is measured.

A word's form is the near word that occurs most often, if ten times as often as itself; its root is
where following forms ends.

A side that many words share is dealt over many tasks, by its number of entries. The bigram counts
that every task holds are bounded by the alphabet: 90 letters, 8,100 bigrams.

Defined cases: null and empty texts have no words; a null id counts as an empty one; repeated rows
count as often as they stand; runs of letters of any length are words; ties of frequency go to the
word smaller by code points; empty tables have no words. Other columns are never read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payload_metrics.llm.common import new_folder, text_of
from payload_metrics.sources.tables import discard, stage

#: Letters of a word once A-Z is in lower case: 26 and 64.
RUN = "[a-zÀ-ÿ]+"
SLIP = 31
MIN_LENGTH, MIN_OCCURRENCES = 7, 2
FORM_RATIO = 10
GRAM, EDITS = 2, 1
#: Prefix entries of one side and length that one task takes.
ENTRIES_TOGETHER = 4096


def runs(docs: DataFrame) -> DataFrame:
    """``(run)`` for every run of letters of every text, A-Z in lower case; where 31 divides the crc32
    of ``id:run``, without the code point that the crc32 picks."""
    lower = F.translate(text_of(), string.ascii_uppercase, string.ascii_lowercase)
    found = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"),
    )
    h = F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "utf-8"))
    at = (h % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return found.select(F.when(h % SLIP == 0, cut).otherwise(F.col("run")).alias("run"))


def words(docs: DataFrame, min_length: int = MIN_LENGTH, min_occurrences: int = MIN_OCCURRENCES) -> DataFrame:
    """``(word, n)`` for the long and repeated words of all texts."""
    long = runs(docs).where(F.char_length("run") >= min_length)
    counted = long.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= min_occurrences)


def pivots(positions: list[int], weights: list[int], count: int = EDITS + 1, width: int = GRAM) -> list[int]:
    """The ``count`` disjoint grams of least total weight among those at ascending ``positions``."""
    # best[k]: least weight of k disjoint grams among those so far, with the grams, for every place.
    best: list[list[tuple[float, tuple[int, ...]]]] = [[(0, ())] * (len(positions) + 1)]
    for k in range(1, count + 1):
        row: list[tuple[float, tuple[int, ...]]] = [(float("inf"), ())]
        clear = 0
        for i, at in enumerate(positions):
            while positions[clear] <= at - width:
                clear += 1
            weight, chosen = best[k - 1][clear]
            row.append(min(row[-1], (weight + weights[i], (*chosen, at))))
        best.append(row)
    return list(best[count][-1][1])


def _chosen(words: DataFrame) -> DataFrame:
    """``(word, n, last, letters, prefix, pivots)``: the rank of the prefix's last bigram, the set of
    letters as bits, and positions."""
    letters = F.char_length("word")
    places = F.sequence(F.lit(1), letters - (GRAM - 1))
    grams = words.select(F.explode(F.transform(places, lambda at: F.substring("word", at, F.lit(GRAM)))).alias("gram"))
    counts = {row["gram"]: row["n"] for row in grams.groupBy("gram").agg(F.count("*").alias("n")).collect()}
    ranks = {gram: rank for rank, gram in enumerate(sorted(counts, key=lambda g: (counts[g], g)))}

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word in batch.column("word").to_pylist():
                grams = [word[i : i + GRAM] for i in range(len(word) - GRAM + 1)]
                order = [ranks[gram] for gram in grams]
                last = sorted(order)[GRAM * EDITS]
                prefix = [i for i, rank in enumerate(order) if rank <= last]
                rows.append((last, _letter_bits(word), prefix, pivots(prefix, [counts[grams[i]] for i in prefix])))
            last, bits, prefix, pivot = zip(*rows) if rows else ((), (), (), ())
            places = pa.list_(pa.int32())
            columns = [pa.array(last, pa.int32()), pa.array(bits, pa.int64()), pa.array(prefix, places), pa.array(pivot, places)]
            yield pa.record_batch(
                [batch.column("word"), batch.column("n"), *columns], names=["word", "n", "last", "letters", "prefix", "pivots"]
            )

    schema = "word string, n long, last int, letters long, prefix array<int>, pivots array<int>"
    return words.select("word", "n").mapInArrow(chosen, schema)


def _letter_bits(word: str) -> int:
    """A bit for every letter, by its code point modulo 64, as a signed 64-bit number."""
    bits = 0
    for letter in set(word):
        bits |= 1 << (ord(letter) & 63)
    return bits - (1 << 64) if bits >> 63 else bits


def _sides(at: Column) -> Column:
    """What stands up to the bigram at ``at``, and from it on."""
    up_to = F.substring("word", F.lit(1), at + GRAM)
    onwards = F.substring("word", at + 1, F.char_length("word"))
    return F.array(
        F.struct(F.lit(True).alias("head"), up_to.alias("side")), F.struct(F.lit(False).alias("head"), onwards.alias("side"))
    )


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n, other, other_n)``, each pair of ``words (word, n)`` one edit apart, both ways.

    Words have four code points or more, all of ``RUN``; no word is repeated.
    """
    spark = words.sparkSession
    chosen_path, entries_path = new_folder(spark, "pivots"), new_folder(spark, "entries")
    chosen = stage(_chosen(words), "pivots", chosen_path)
    key = ["head", "side", "length"]
    length = F.char_length("word").alias("length")
    about = ["word", "n", "last", "letters"]
    entries = chosen.select(*about, length, F.explode(F.flatten(F.transform("prefix", _sides))).alias("e"))
    entries = stage(entries.select("e.*", "length", *about), "entries", entries_path)
    probes = chosen.select(*about, length, F.explode(F.flatten(F.transform("pivots", _sides))).alias("e"))
    other_lengths = F.explode(F.array(*[F.col("length") + d for d in range(-EDITS, EDITS + 1)])).alias("length")
    probes = probes.select("e.*", other_lengths, *about)

    crowded = entries.groupBy(*key).agg(F.count("*").alias("size")).where(F.col("size") > ENTRIES_TOGETHER)
    crowded = stage(
        crowded.select(*key, F.ceil(F.col("size") / ENTRIES_TOGETHER).cast("int").alias("parts")), "crowded", new_folder(spark, "crowded")
    )
    parts = F.coalesce("parts", F.lit(1))
    entries = entries.join(crowded, key, "left").withColumn("part", F.pmod(F.xxhash64("word"), parts).cast("int"))
    probes = probes.join(crowded, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))

    a, b = probes.alias("a"), entries.alias("b")
    met = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*key, "part"]]
    # One edit takes at most one letter away and brings at most one.
    alike = F.bit_count(F.col("a.letters").bitwiseXOR(F.col("b.letters"))) <= 2 * EDITS
    verified = F.levenshtein(F.col("a.word"), F.col("b.word"), EDITS) == EDITS
    pairs = a.join(b, [*met, F.col("a.last") <= F.col("b.last"), alike, verified])
    one, two = F.struct("a.word", "a.n"), F.struct("b.word", "b.n")
    pairs = pairs.select(F.least(one, two).alias("one"), F.greatest(one, two).alias("two")).distinct()
    both = F.explode(F.array(F.struct("one", "two"), F.struct(F.col("two").alias("one"), F.col("one").alias("two"))))
    found = pairs.select(both.alias("p")).select(
        F.col("p.one.word").alias("word"), F.col("p.one.n").alias("n"), F.col("p.two.word").alias("other"), F.col("p.two.n").alias("other_n")
    )
    found = stage(found, "near", new_folder(spark, "near-words"))
    for path in (chosen_path, entries_path):
        discard(spark, path)
    return found


def variants(words: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of ``words (word, n)``."""
    spark = words.sparkSession
    path = new_folder(spark, "words")
    words = stage(words.select("word", "n"), "words", path)
    # The least value is the near word of largest n, and of those the smallest.
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), "other"))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    best_n = -F.col("best.minus")
    formed = words.join(near, "word", "left")
    formed = formed.withColumn("form", F.when(best_n >= ratio * F.col("n"), F.col("best.other")))
    formed = formed.select(
        "word", "form", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("form").isNotNull(), best_n).alias("form_n")
    )
    formed = stage(formed, "forms", new_folder(spark, "forms"))
    discard(spark, path)
    roots = _roots(formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    rooted = formed.join(roots, "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame) -> DataFrame:
    """Where following ``forms (word, root)`` ends; every round doubles the steps taken.

    A form occurs ten times as often as its word, so no chain is long and none is a ring.
    """
    spark = forms.sparkSession
    path = new_folder(spark, "roots")
    forms, moved = stage(forms, "roots", path), True
    while moved:
        ahead = forms.select(F.col("word").alias("root"), F.col("root").alias("next"))
        next_path = new_folder(spark, "roots")
        stepped = forms.join(ahead, "root", "left")
        stepped = stage(stepped.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots", next_path)
        moved = bool(stepped.where("moved").limit(1).count())
        discard(spark, path)
        forms, path = stepped.select("word", "root"), next_path
    return forms
