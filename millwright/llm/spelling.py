"""Spelling variants: words one edit apart, found by blocked Gram matrices of their letter counts.

1. Words are counted over all documents: by task first, then by word.
2. A word is a vector of letter counts.  One inserted or deleted letter makes a squared distance of 1, a replaced one of 2, so
   near words have one length or neighbouring ones.  Length blocks are divided by how many letters of each of a few classes a
   word has: one edit moves one letter from class to class, so a block meets few others.  A block with more words than one
   product takes is dealt into several by hash.
3. Each pair of blocks is one product of two count matrices, which gives all squared distances; pairs at most two apart are
   kept and verified letter by letter.
4. A word's form is its most frequent near word, if that is much more frequent; roots follow forms, by doubling.
"""

from __future__ import annotations

import zlib
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import removed, runs, shared_dir, tidy, written

#: Code points and occurrences that a word has at least, and how many times as frequent its form is.
LEAST_LETTERS, LEAST_TIMES, FORM_TIMES = 6, 5, 5
#: Words of a block, at most (about: blocks are dealt by hash); a product has the square of that many entries.
BLOCK_WORDS = 1024
#: Distinct words that a task counts before it gives sums out.
_HELD = 200_000
#: Letter classes that divide length blocks: (code point * 7 + code point // 5) % CLASSES.
CLASSES = 4
#: Pairs of cells are sent to every task up to so many (some 60 bytes each), and joined beyond.
SENT_UNITS = 1 << 16
#: Letters are A-Z, a-z and the code points C0 to FF; A-Z count as a-z.
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC0, 0x100))
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c in _LETTERS else 32 for c in range(256))


def letter_runs(text: str) -> list[bytes]:
    """Maximal runs of letters, A-Z as a-z, in Latin-1; all letters are in it."""
    return text.encode("latin-1", "replace").translate(_TABLE).split()


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, least_times: int = LEAST_TIMES, slip: int | None = None) -> DataFrame:
    """(word, n) of the letter runs of at least so many code points that occur so often in all documents together.

    ``slip``: a run loses its code point h % length where ``slip`` divides h, the crc32 of ``<id>:<run>``; it then counts as what is left.
    """

    def count(batches):
        held: dict[bytes, int] = {}

        def sums():
            kept = [(w, n) for w, n in held.items() if len(w) >= least_letters]
            return pa.record_batch([pa.array([w.decode("latin-1") for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                begun = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                slipped: dict[bytes, bytes] = {}  # what each of the document's runs counts as
                for run in letter_runs(text.as_py()):
                    if slip:
                        if (word := slipped.get(run)) is None:
                            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), begun)
                            word = slipped[run] = run if h % slip else run[: h % len(run)] + run[h % len(run) + 1 :]
                        run = word
                    held[run] = held.get(run, 0) + 1
                if len(held) > _HELD:
                    yield sums()
                    held.clear()
        yield sums()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(tidy(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_times)


def _cell(word: str) -> tuple[int, ...]:
    counts = [0] * CLASSES
    for c in word.encode("latin-1"):
        counts[(c * 7 + c // 5) % CLASSES] += 1
    return tuple(counts)


def _neighbours(cell: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Cells that one edit of a word in ``cell`` can lead to, itself included."""
    found = [cell]
    for i in range(CLASSES):
        for step in (1, -1):
            found.append((*cell[:i], cell[i] + step, *cell[i + 1 :]))
    for i, j in product(range(CLASSES), repeat=2):
        if i != j:
            moved = list(cell)
            moved[i] += 1
            moved[j] -= 1
            found.append(tuple(moved))
    return [c for c in found if min(c) >= 0]


def _key(cell: tuple[int, ...]) -> str:
    return ",".join(map(str, cell))


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes one word of the other."""
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :])


def letter_counts(words: list[str]) -> np.ndarray:
    """A row of letter counts for each word."""
    raw = "".join(words).encode("latin-1")
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    flat = np.bincount(owner * 256 + np.frombuffer(raw, np.uint8), minlength=256 * len(words)).reshape(-1, 256)
    return flat[:, flat.any(axis=0)].astype(np.float32)


def near_pairs(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """Pairs of one word of each list that are one edit apart.

    Squared distances come from one product of the lists' count matrices; counts are whole numbers that float32 holds exactly.
    """
    counts = letter_counts(left + right)
    a, b = counts[: len(left)], counts[len(left) :]
    apart = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return [(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(apart <= 2))) if one_edit(left[i], right[j])]


def near_words(words: DataFrame, *, block_words: int = BLOCK_WORDS, sent_units: int = SENT_UNITS) -> DataFrame:
    """(word, n, near, near_n) of all pairs of words that are one edit apart, each pair both ways.

    ``words`` (word, n) has each word once, of letters as ``letter_runs`` gives them; an empty table gives an empty one.
    """
    spark = words.sparkSession
    folder = shared_dir(spark)

    def celled(batches):
        for batch in batches:
            yield pa.record_batch([*batch.columns, pa.array([_key(_cell(w)) for w in batch.column("word").to_pylist()], pa.string())], ["word", "n", "cell"])

    def met(batches):
        """Each cell with those it can meet and that do not come before it."""
        for batch in batches:
            pairs = [(i, other) for i, c in enumerate(batch.column("cell").to_pylist()) for other in map(_key, _neighbours(tuple(map(int, c.split(","))))) if other >= c]
            rows = pa.array([i for i, _ in pairs], pa.int64())
            yield pa.record_batch([batch.column("cell").take(rows), batch.column("m").take(rows), pa.array([o for _, o in pairs], pa.string())], ["cell", "m", "other"])

    held = written(words.mapInArrow(tidy(celled), "word string, n long, cell string"), folder=f"{folder}/words")
    cells = written(held.groupBy("cell").agg(F.ceil(F.count("*") / block_words).cast("int").alias("m")), folder=f"{folder}/cells")
    meetings = cells.mapInArrow(tidy(met), "cell string, m int, other string").join(cells.select(F.col("cell").alias("other"), F.col("m").alias("m2")), "other")
    units = written(meetings, folder=f"{folder}/units")
    few = F.broadcast(units) if units.count() <= sent_units else units
    # of the blocks x of cell and y of other each pair meets once; within one cell, x <= y
    own = lambda m: F.pmod(F.xxhash64("word"), F.col(m)).cast("int")
    each = lambda a, b: F.explode(F.expr(f"case when {a} <= {b} then sequence({a}, {b}) else array() end"))
    left = held.join(few, "cell").withColumn("x", own("m")).select("word", "n", "cell", "other", "x", F.lit(0).alias("side"), each("if(cell = other, x, 0)", "m2 - 1").alias("y"))
    as_other = few.withColumnsRenamed({"cell": "first", "other": "cell"})
    right = held.join(as_other, "cell").withColumn("y", own("m2")).select("word", "n", F.col("first").alias("cell"), F.col("cell").alias("other"), F.lit(1).alias("side"), "y", each("0", "if(first = cell, y - 1, m - 1)").alias("x"))
    dealt = left.unionByName(right).select(F.xxhash64("cell", "other", "x", "y").alias("part"), "side", "word", "n")

    def compare(batches):
        for _, table in runs(batches, "part"):
            word, n, side = (table[c].to_pylist() for c in ("word", "n", "side"))
            at = [[i for i, s in enumerate(side) if s == k] for k in (0, 1)]
            a, b = ([word[i] for i in rows] for rows in at)
            pairs = [(at[0][i], at[1][j]) for i, j in near_pairs(a, b)] if b else [(i, j) for i, j in near_pairs(a, a) if i < j]
            both = [*pairs, *((j, i) for i, j in pairs)]
            yield pa.record_batch([pa.array([x[k] for k in ks], t) for x, t, ks in ((word, pa.string(), [p[0] for p in both]), (n, pa.int64(), [p[0] for p in both]), (word, pa.string(), [p[1] for p in both]), (n, pa.int64(), [p[1] for p in both]))], ["word", "n", "near", "near_n"])

    found = dealt.repartition("part").sortWithinPartitions("part").mapInArrow(tidy(compare), "word string, n long, near string, near_n long")
    near = written(found.distinct())  # a pair comes twice only where two parts have one hash
    removed(spark, folder)
    return near


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, least_times: int = LEAST_TIMES, form_times: int = FORM_TIMES, slip: int | None = None, block_words: int = BLOCK_WORDS, sent_units: int = SENT_UNITS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word that occurs often enough (see ``word_counts``).

    n_near: how many words are one edit apart.  form: of those the one of largest n (of equals the least in code-point order), if
    its n, form_n, is at least ``form_times`` the word's; else both are null.  root: where following forms ends, the word itself
    without a form.

    A null text counts as empty, a null id as an empty one; repeated rows count again; very long texts are read whole; other
    columns are left aside; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    words = written(word_counts(docs, id_col=id_col, text_col=text_col, least_letters=least_letters, least_times=least_times, slip=slip), folder=f"{folder}/counts")
    near = near_words(words, block_words=block_words, sent_units=sent_units)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("b"), F.first("n").alias("own"))
    strong = -F.col("b.less") >= form_times * F.col("own")
    forms = written(best.select("word", "n_near", F.when(strong, F.col("b.form")).alias("form"), F.when(strong, -F.col("b.less")).alias("form_n")))
    roots, step = forms.filter("form is not null").select("word", F.col("form").alias("root")), 0
    while True:  # n grows by form_times with each form, so chains are short and doubling takes few rounds
        after = roots.select(F.col("word").alias("root"), F.col("root").alias("far"))
        new = written(roots.join(after, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), folder=f"{folder}/roots{step}")
        roots, step = new.select("word", "root"), step + 1
        if new.filter("moved").isEmpty():
            break
    return words.join(forms, "word", "left").join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
