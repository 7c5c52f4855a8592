"""Benchmark decontamination by winnowing: words of documents that stand in any 10-word window of a benchmark item.

A word is a run of characters other than the ASCII ones that are no letters or digits, A-Z in lower case. A window is 10
consecutive words of an item; an item of fewer words, but not of none, is one window of that length. Of every window of n
words the k-gram of least hash (k about n / 2) is its fingerprint. In documents the same choice is made for every run of
n words, so that a run equal to a window shares its fingerprint: no shared span of n words is missed. Fingerprints are
joined first; the hits are extended to all windows around them, and these are joined with the windows of the benchmark
word by word, so that a hash that two grams share gives no false hit. While the fingerprints of the benchmark are few enough
to broadcast, no text is shuffled: a hit takes the words around it along. Beyond that, narrow rows are shuffled.

All is DataFrame functions. A document is known by the hash of its whole text, so copies are extended and looked up once.
No join is between rows of one key on both sides: a fingerprint and a window are there once on the benchmark's side.

Cases: null and empty texts have no words and no hits. Equal items have the same windows; an item_id that stands in
several rows counts once, an item without id marks words but is not counted. Rows of the documents that repeat are each
returned. Without windows nothing is hit. Extra columns of both tables are dropped. Empty in, empty out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglathe.llm import linking

WINDOW = 10
BROADCAST_ROWS = 1 << 21  # fingerprints (8 bytes each) sent to all executors; more are joined by a shuffle

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(lowered, _SEPARATORS, -1), lambda w: w != "")


def _named(value: Column, use) -> Column:
    """`use(x)` with x evaluated once, where a plain column would be evaluated again for every element inside."""
    return F.transform(F.array(value), use)[0]


def gram_size(n: int) -> int:
    return (n + 1) // 2


def _gram(found: Column, n: int, i: Column) -> Column:
    """Hash of the k-gram at place i."""
    return F.xxhash64(F.lit(n), *[F.get(found, i + j) for j in range(gram_size(n))])


def _grams(found: Column, n: int) -> Column:
    """Hash of every k-gram, in order."""
    k = gram_size(n)
    places = F.sequence(F.lit(0), F.greatest(F.size(found) - k, F.lit(0)))
    return F.transform(
        F.when(F.size(found) >= k, places).otherwise(F.array().cast("array<int>")), lambda i: _gram(found, n, i)
    )


def fingerprints(found: Column, n: int) -> Column:
    """(size, place, gram) of every k-gram that has the least hash of some run of n words; ties are all kept."""
    span = n - gram_size(n) + 1  # grams of a run

    def least(grams: Column) -> Column:
        starts = F.when(F.size(grams) >= span, F.sequence(F.lit(0), F.greatest(F.size(grams) - span, F.lit(0))))
        if span == 1:
            return grams
        return F.transform(
            F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.least(*[F.get(grams, i + j) for j in range(span)])
        )

    def chosen(grams: Column, lows: Column) -> Column:
        def mark(gram: Column, i: Column) -> Column:
            near = [F.get(lows, i - j) for j in range(span)]
            top = F.greatest(*near) if span > 1 else near[0]
            return F.when(top == gram, F.struct(F.lit(n).alias("size"), i.alias("place"), gram.alias("gram")))

        return F.filter(F.transform(grams, mark), lambda x: x.isNotNull())

    return _named(_grams(found, n), lambda grams: _named(least(grams), lambda lows: chosen(grams, lows)))


def _shared_grams(keyed: DataFrame, prints: DataFrame, sizes: list[int]) -> DataFrame:
    """(text_key, w, size, place) of the fingerprints of texts (text_key, w) that are among `prints`, which are broadcast.

    The choice of `fingerprints`, in plain columns, made after the look-up: most grams are not found and cost one hash.
    """
    places = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1))
    rows = keyed.select("text_key", "w", F.explode(places).alias("place"))
    held = {n: F.when(F.col("place") + gram_size(n) <= F.size("w"), _gram(F.col("w"), n, F.col("place"))) for n in sizes}
    if len(sizes) == 1:
        rows = rows.select("*", F.lit(sizes[0]).alias("size"), held[sizes[0]].alias("gram"))
    else:
        rows = rows.select("*", F.inline(F.array(*[F.struct(F.lit(n).alias("size"), g.alias("gram")) for n, g in held.items()])))
    found = rows.join(F.broadcast(prints.select("gram").distinct()), "gram", "left_semi")

    def chosen(n: int) -> Column:
        k = gram_size(n)
        span = n - k + 1
        lows = []
        for back in range(span):
            first = F.col("place") - back
            run = [_gram(F.col("w"), n, first + j) for j in range(span)]
            whole = (first >= 0) & (first + n <= F.size("w"))
            lows.append(whole & reduce(lambda done, g: done & (F.col("gram") <= g), run, F.lit(True)))
        return reduce(lambda done, low: done | low, lows)

    least = reduce(lambda done, n: done.when(F.col("size") == n, chosen(n)), sizes, F)
    # a generator, as a plain filter is moved below the join and is then evaluated for every gram
    return found.select("text_key", "w", "size", "place", F.explode(F.when(least, F.array(F.lit(True)))).alias("least")).drop("least")


def windows_of(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(size, window, item): the distinct windows of every item, as words joined by spaces."""
    found = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w"))
    found = found.where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(WINDOW))
    each = F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.array_join(F.slice("w", i, size), " "))
    return found.select(size.alias("size"), F.explode(each).alias("window"), "item").distinct()


def _gram_of(window: Column, n: int) -> Column:
    """The fingerprint of a window of n words: the least hash of its k-grams."""
    return F.array_min(_named(F.split(window, " ", -1), lambda w: _grams(w, n)))


def hit_windows(docs: DataFrame, windows: DataFrame, text_col: str = "text") -> DataFrame:
    """(text_key, size, start, window): every occurrence of a benchmark window in a distinct text of the documents.

    `windows` are stored distinct (size, window). The number of different sizes is WINDOW at most.
    """
    spark = docs.sparkSession
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())
    if not sizes:
        return spark.createDataFrame([], "text_key binary, size int, start int, window string")
    gram = reduce(lambda done, n: done.when(F.col("size") == n, _gram_of(F.col("window"), n)), sizes, F)
    prints = linking.stored(windows.select("size", gram.alias("gram")).distinct(), "window-prints")
    # words and marks are columns of their own, so that what follows the explode only passes them by
    keyed = docs.select(text_key(text_col).alias("text_key"), words(F.col(text_col)).alias("w"))
    place = ["text_key", "size", "place"]
    if prints.count() <= BROADCAST_ROWS:
        shared = _shared_grams(keyed, prints, sizes).select(*place, *_context(F.col("w")))
    else:  # narrow rows are shuffled, and only texts with a shared fingerprint are looked into again
        marked = keyed.withColumn("marks", _named(F.col("w"), lambda w: F.concat(*[fingerprints(w, n) for n in sizes])))
        rows = marked.select("text_key", F.explode("marks").alias("p")).select("text_key", "p.size", "p.place", "p.gram")
        found = rows.join(prints, ["size", "gram"], "left_semi").select(*place).distinct()
        found = found.groupBy("text_key").agg(F.collect_list(F.struct("size", "place")).alias("places"))
        texts = keyed.join(found, "text_key").groupBy("text_key").agg(F.first("w").alias("w"), F.first("places").alias("places"))
        each = texts.select("text_key", "w", F.explode("places").alias("p")).select("text_key", "w", "p.size", "p.place")
        shared = each.select(*place, *_context(F.col("w")))
    # of a text that stands in many rows, the places are summed up before they are shuffled
    shared = shared.groupBy(*place).agg(F.first("first").alias("first"), F.first("near").alias("near"))
    starts = F.least(F.col("place"), F.col("first") + F.size("near") - F.col("size"))
    each = F.transform(
        F.when(starts >= F.col("first"), F.sequence("first", F.greatest(starts, F.col("first")))),
        lambda s: F.struct(s.alias("start"), F.array_join(F.slice("near", s - F.col("first") + 1, F.col("size")), " ").alias("window")),
    )
    near = shared.select("text_key", "size", F.explode(each).alias("x")).select("text_key", "size", "x.start", "x.window")
    return near.join(windows, ["size", "window"], "left_semi").distinct()


def _context(w: Column) -> list[Column]:
    """The words of all windows that a fingerprint at `place` can be that of, and the place of their first word."""
    size, place = F.col("size"), F.col("place")
    before = size - F.floor((size + 1) / 2).cast("int")
    first = F.greatest(place - before, F.lit(0))
    return [first.alias("first"), F.slice(w, first + 1, place - first + size).alias("near")]


def text_key(text_col: str = "text") -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))


def _covered(spans: Column) -> Column:
    """Words inside the union of (start, size) spans."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def add(done: Column, x: Column) -> Column:
        stop = x["start"] + x["size"]
        new = F.greatest(stop - F.greatest(done["end"], x["start"]), F.lit(0))
        return F.struct((done["n"] + new).alias("n"), F.greatest(done["end"], stop).alias("end"))

    return F.aggregate(F.array_sort(spans), zero, add, lambda done: done["n"])


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """Per row of `docs`: id, n_words, n_hit, `items` (ids of items with occurring windows, sorted as strings).

    The spans that are hit are in `spans` as (start, size) in words.
    """
    held = linking.stored(windows_of(benchmark, item_col, "text"), "windows")
    windows = held.select("size", "window").distinct()
    hits = linking.stored(hit_windows(docs, windows, text_col), "hits")
    spans = hits.groupBy("text_key").agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("spans"))
    found = hits.select("text_key", "size", "window").distinct().join(held, ["size", "window"]).where("item is not null")
    items = found.select("text_key", "item").distinct().groupBy("text_key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    of_text = linking.stored(spans.join(items, "text_key", "left"), "hit-texts")
    rows = docs.select(
        F.col(id_col), text_key(text_col).alias("text_key"), F.size(words(F.col(text_col))).cast("long").alias("n_words")
    )
    none = F.array().cast("array<string>")
    return rows.join(of_text, "text_key", "left").select(
        id_col,
        "n_words",
        F.coalesce(_covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", none).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,size:int>>")).alias("spans"),
    )
