"""Groups of spelling variants by anagram hashing.

The key of a word is the sum of the fifth powers of its letters, so that the order of letters
does not matter and one letter more, less or exchanged changes the key by a known value. A
word gives its own key and its key less each of its letters: equal values join words a letter
apart (own with less) and words with one letter exchanged (less with less). Joined words
also share the first or the second half of the shorter one, as an edit leaves one half as it is;
so anagrams do not meet in one group. The order of letters is then verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.session import growing, staged

LETTERS = r"[A-Za-zÀ-ÿ]"
#: Runs whose checksum this divides lose a letter.
DAMAGED = 199
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Keys are taken modulo this, so that no sum of powers is too large for a long.
MODULUS = 1 << 61


def word_counts(docs: DataFrame, least: int = LEAST_LENGTH, damaged: int = DAMAGED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of letters with A-Z in lower case, some of them with a letter lost, of ``least`` letters or more.

    Runs come from whole texts; null and empty texts have none. A run of which ``damaged`` divides the
    CRC-32 of ``<doc_id>:<run>`` loses its letter at that CRC modulo its length; a null id is written
    as nothing. Repeated rows count again. An empty table gives no rows; other columns are not read.
    """
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # A shorter run cannot become longer.
    runs = F.explode(F.regexp_extract_all(lower, F.lit(LETTERS + f"{{{least},}}+"), F.lit(0)))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), runs.alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    word = F.when(F.col("h") % damaged == 0, shorter).otherwise(F.col("run"))
    return rows.withColumn("h", h).select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))


def _power(letter: Column) -> Column:
    x = F.ascii(letter).cast("long")
    return x * x * x * x * x


def anagram_key(letters: Column) -> Column:
    """Sum of the fifth powers of the letters of an array, modulo MODULUS."""
    return F.aggregate(letters, F.lit(0).cast("long"), lambda total, c: (total + _power(c)) % MODULUS)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): every two words that differ by one letter, both ways round; ``words`` are distinct (word, n).

    A word becomes some 20 rows, which Spark does not count when it sizes a table; so joins shuffle them, whatever their number.
    """
    letters = F.split("word", "")
    keyed = growing(words).select("word", "n", F.length("word").alias("size"), letters.alias("letters")).withColumn("key", anagram_key(F.col("letters")))

    def halves(size: Column) -> Column:
        """The first and the last letters of a word, half as many as ``size``: the length of the shorter word of a pair."""
        half = F.floor(size / 2).cast("int")
        first = F.struct(F.lit(0).alias("side"), F.col("word").substr(F.lit(1), half).alias("half"))
        return F.array(first, F.struct(F.lit(1).alias("side"), F.col("word").substr(F.length("word") - half + 1, half).alias("half")))

    less = F.explode(F.transform(F.array_distinct("letters"), lambda c: F.struct(F.pmod(F.col("key") - _power(c), F.lit(MODULUS)).alias("key"), c.alias("lost"))))
    shrunk = keyed.select("word", "n", "size", less.alias("less"))

    def dealt(df: DataFrame, key: str, size: Column, lost: Column) -> DataFrame:
        return df.select("word", "n", F.col(key).alias("key"), lost.alias("lost"), F.explode(halves(size)).alias("at")).select("word", "n", "key", "lost", "at.side", "at.half")

    gone, kept = dealt(shrunk, "less.key", F.col("size") - 1, F.col("less.lost")), dealt(keyed, "key", F.col("size"), F.lit(""))
    exchanged = dealt(shrunk, "less.key", F.col("size"), F.col("less.lost"))
    names = {c: f"other_{c}" for c in ("word", "n", "lost")}
    pair = lambda a, b: a.join(b.withColumnsRenamed(names), ["key", "side", "half"])
    longer = pair(gone, kept).where("length(word) = length(other_word) + 1")
    same = pair(exchanged, exchanged).where("lost < other_lost AND length(word) = length(other_word)")
    found = longer.unionByName(same).where("levenshtein(word, other_word, 1) = 1")
    # Both halves are equal only where the middle letter of an odd word differs; such a pair is taken once.
    half = F.floor(F.least(F.length("word"), F.length("other_word")) / 2).cast("int")
    once = (F.col("side") == 0) | (F.col("word").substr(F.lit(1), half) != F.col("other_word").substr(F.lit(1), half))
    both = F.explode(F.array(F.struct("word", "n", F.col("other_word").alias("other"), "other_n"), F.struct(F.col("other_word").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))))
    return found.where(once).select(both.alias("p")).select("p.*")


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last. Each round doubles the steps taken, and chains are short, as a form is at least RATIO times as frequent."""
    ways = growing(staged(forms.select("word", F.col("form").alias("root")), "roots"))
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = staged(ways.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        ways = growing(after.select("word", "root"))
        if not after.where("moved").limit(1).count():
            return ways


def spelling_groups(docs: DataFrame, least: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, damaged: int = DAMAGED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of ``least`` letters or more that occurs ``least_count`` times or more.

    Words and their counts are those of `word_counts`; equal counts of near words go to the first in the
    order of code points. Tables without such words give no rows. Other columns may have any names.
    """
    words = growing(staged(word_counts(docs, least, damaged, id_col, text_col).where(F.col("n") >= least_count), "words"))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    taken = -F.col("best.less") >= ratio * F.col("n")
    joined = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.form")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n")
    )
    found = growing(staged(joined, "forms"))
    roots = roots_of(found.where("form IS NOT NULL").select("word", "form"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
