"""Repeated-passage removal by winnowing over hashed words.

A text's words are hashed. Of each ``window`` neighbouring places the one whose
word has the least hash is selected (of equal ones the first); its fingerprint
is the hash of the ``gram`` words from there on. A passage of
``gram + window - 1`` words (25) that occurs twice therefore selects the same
fingerprint both times, wherever in lines or sentences it begins and ends:
windows of hashed lines would miss what is cut inside lines.

Joining positions. A fingerprint's first place (by doc_id, then place) is a
hash aggregate over one row for each selected place. Every other
place of a repeated fingerprint is an anchor against the first.

Extension. From an anchor the match goes on both ways, word by word, as far as
both texts agree (and ``AROUND`` words beyond the outermost anchors at most);
anchors inside a match already found are passed over. Matches of ``piece``
words or more cover words that stood earlier, and covered runs of
``min_words`` words or more are deleted with the white space behind them. A
run may have stood earlier in several parts, each in another text, so a
passage goes also where every fingerprint of it stood still earlier elsewhere.
What is first stays.

Style. DataFrame operations only. What is done for each word is kept few and
compiled: one ``split``, one hash, and a comparison with the least of its
neighbours on exploded places. Functions on arrays, which are interpreted,
otherwise see anchors, 64 words around them, and texts that lose a run.

Cost. Bit tables (``_marks``; of bounded size whatever the input, and no more
than a saving: what passes them is joined all the same) keep fingerprints that
stand once, and texts without matches, out of the later joins. Those are plain
equi-joins of written tables, which Spark splits where a key is hot; nothing
pairs the places of a fingerprint with each other.

Defined results: null stays null and empty stays empty; equal rows (same
doc_id and text) are one document and keep one decision; rows that share a
doc_id but not the text are two documents, ordered by the text's hash; a null
doc_id is never deleted from or compared; all columns are kept; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitquarry.llm._common import drop_folder, materialize, read

GRAM = 13
WINDOW = 13
MIN_WORDS = 25
PIECE = 10
#: words that are carried along beyond the outermost anchors of two texts
AROUND = 64
MOST_BITS = 1 << 26

_TH = "__bq_th"
_SPACE = r"[\x09-\x0D ]+"
#: between white space and the next word
_EDGE = r"(?<=[\x09-\x0D ])(?=[^\x09-\x0D ])"


def word_hashes(text: Column) -> Column:
    """A 64-bit hash of each word of text; what the split leaves empty at the ends is taken out."""
    return F.array_remove(F.transform(F.split(text, _SPACE), lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x evaluated once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, text hash, fp and pos (its first word) of each selected place."""
    rows = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias(_TH), word_hashes(F.col("text").cast("string")).alias("h"))
    h, i, n = F.col("h"), F.col("i"), F.size("h")
    # windows begin at i; a text of fewer places has one window of all of them
    begins = F.when(n >= gram, F.sequence(F.lit(0), F.greatest(F.lit(0), n - (gram + window - 1))))
    places = rows.select("doc_id", _TH, "h", F.explode(begins).alias("i"))
    inner = F.least(*[F.get(h, i + j) for j in range(window - 1)]) if window > 2 else F.get(h, i)
    # the selected place changes if it was the one before this window, or if it is the last of this one
    changed = places.filter((i == 0) | (F.get(h, i - 1) <= inner) | (F.get(h, i + (window - 1)) < inner)) if window > 1 else places
    here = F.slice(h, i + 1, F.least(F.lit(window), n - (gram - 1) - i))
    at = changed.select("doc_id", _TH, "h", (i + F.array_position(here, F.array_min(here)).cast("int") - 1).alias("pos"))
    return at.select("doc_id", _TH, F.xxhash64(F.slice(h, F.col("pos") + 1, gram)).alias("fp"), "pos")


def _first(rows: DataFrame, plain: bool) -> DataFrame:
    """Fingerprints that stand more than once, with their first place: fp, a_id, a_th, a_pos."""
    often = (F.count("*") > 1).alias("often")
    if plain:  # a text for each doc_id, and doc_id and place fit a long: everything fits a hash aggregate
        at = F.shiftleft("doc_id", 24).bitwiseOR(F.col("pos").cast("long"))
        got = rows.withColumn("at", at).groupBy("fp").agg(F.min("at").alias("a"), F.min_by(_TH, "at").alias("a_th"), often).filter("often")
        return got.select("fp", F.shiftright("a", 24).alias("a_id"), "a_th", F.col("a").bitwiseAND(F.lit((1 << 24) - 1)).cast("int").alias("a_pos"))
    got = rows.groupBy("fp").agg(F.min(F.struct("doc_id", _TH, "pos")).alias("a"), often).filter("often")
    return got.select("fp", F.col("a.doc_id").alias("a_id"), F.col(f"a.{_TH}").alias("a_th"), F.col("a.pos").alias("a_pos"))


def _plain(rows: DataFrame) -> bool:
    """Whether each doc_id has one text, and doc_id and place fit a long."""
    each = rows.groupBy("doc_id").agg((F.min(_TH) != F.max(_TH)).alias("two"), F.max("pos").alias("pos"))
    got = each.agg(F.max("two"), F.min("doc_id"), F.max("doc_id"), F.max("pos")).first()
    return got[0] is None or not got[0] and -(1 << 39) <= got[1] and got[2] < 1 << 39 and got[3] < 1 << 24


def _marks(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """A bit table of the column k of keys, 16 bits a key or more up to MOST_BITS, and its size."""
    bits = 1 << 16
    while bits < 16 * n and bits < MOST_BITS:
        bits *= 2
    x = F.pmod(F.xxhash64("k", F.lit(7)), F.lit(bits))
    return keys.select(x.alias("x")).groupBy(F.shiftright("x", 6).alias("__bq_w")).agg(F.bit_or(F.expr("shiftleft(1L, int(x & 63))")).alias("__bq_bits")), bits


def _maybe(df: DataFrame, key: Column, marks: tuple[DataFrame, int]) -> DataFrame:
    """df with __bq_in: false only where key is not among the marked ones."""
    table, bits = marks  # MOST_BITS / 64 rows of two longs at most
    x = F.pmod(F.xxhash64(key, F.lit(7)), F.lit(bits))
    joined = df.withColumn("__bq_x", x).withColumn("__bq_w", F.shiftright("__bq_x", 6)).join(F.broadcast(table), "__bq_w", "left")
    return joined.withColumn("__bq_in", F.coalesce(F.expr("(shiftright(__bq_bits, int(__bq_x & 63)) & 1) = 1"), F.lit(False))).drop("__bq_x", "__bq_w", "__bq_bits")


def anchors(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, text hash, a_id, a_th and the anchors (pos, a_pos, in order) of each document against each earlier text or place, with the outermost a_pos; written."""
    fps = materialize(fingerprints(docs.select("doc_id", "text"), gram, window))
    first = materialize(_first(fps, _plain(fps)))
    repeated = _maybe(fps, F.col("fp"), _marks(first.select(F.col("fp").alias("k")), first.count())).filter("__bq_in").drop("__bq_in")
    later = F.struct("doc_id", _TH, "pos") > F.struct("a_id", "a_th", "a_pos")
    met = repeated.join(first, "fp").filter(later)
    out = materialize(met.groupBy("doc_id", _TH, "a_id", "a_th").agg(F.sort_array(F.collect_set(F.struct("pos", "a_pos"))).alias("at"), F.min("a_pos").alias("low"), F.max("a_pos").alias("high")))
    drop_folder(fps)
    drop_folder(first)
    return out


def earlier_parts(docs: DataFrame, pairs: DataFrame, gram: int = GRAM) -> DataFrame:
    """For each document with anchors, __bq_parts: the word hashes of earlier texts around them, the number of the first word, and the anchors."""
    ids = pairs.select(F.col("a_id").alias("k")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("a_id"), F.hash("text").alias("a_th"), F.col("text").cast("string").alias("text"))
    near = _maybe(texts, F.col("a_id"), _marks(ids, ids.count())).filter("__bq_in").select("a_id", "a_th", word_hashes(F.col("text")).alias("h"))
    word = F.greatest(F.col("low") - AROUND, F.lit(0))
    part = F.struct(F.slice("h", word + 1, F.col("high") + (gram + AROUND) - word).alias("a"), word.alias("word"), "at")
    return pairs.join(near, ["a_id", "a_th"]).groupBy("doc_id", _TH).agg(F.collect_set(part).alias("__bq_parts"))


def _agree(a: Column, i: Column, b: Column, j: Column, n: Column, back: bool) -> Column:
    """How many words agree one after the other, of n from a[i] and b[j] on, or of n before them."""

    def first(i: Column, j: Column, n: Column) -> Column:
        some = [F.reverse(F.slice(x, k - n + 1, n)) if back else F.slice(x, k + 1, n) for x, k in ((a, i), (b, j))]
        return F.array_position(F.concat(F.zip_with(*some, lambda x, y: x == y), F.array(F.lit(False))), False).cast("int") - 1

    step = -AROUND if back else AROUND
    return _let(first(i, j, F.least(n, F.lit(AROUND))), lambda k: F.when(k < AROUND, k).otherwise(AROUND + first(i + step, j + step, n - AROUND)))


_RANGES = "array<struct<s:int,e:int>>"


def _range(s: Column, e: Column) -> Column:
    return F.array(F.struct(s.cast("int").alias("s"), e.cast("int").alias("e")))


def covered(h: Column, parts: Column, gram: int, piece: int) -> Column:
    """Maximal matches of ``piece`` words or more with earlier parts, as word ranges."""

    def of(part: Column) -> Column:
        def add(state: Column, x: Column) -> Column:
            at, there = x["pos"], x["a_pos"] - part["word"]
            before = _agree(h, at, part["a"], there, F.least(at, there), True)
            after = _agree(h, at + gram, part["a"], there + gram, F.least(F.size(h) - at, F.size(part["a"]) - there) - gram, False)
            found = _range(at - before, at + gram + after)
            more = _let(found, lambda r: F.when(r[0]["e"] - r[0]["s"] >= piece, F.struct(F.greatest(state["end"], r[0]["e"]).alias("end"), F.concat(state["out"], r).alias("out"))).otherwise(state))
            return F.when(at + gram <= state["end"], state).otherwise(more)

        return F.aggregate(part["at"], F.struct(F.lit(-1).alias("end"), F.array().cast(_RANGES).alias("out")), add, lambda state: state["out"])

    return F.flatten(F.transform(parts, of))


def runs(ranges: Column, least: int) -> Column:
    """The union of ranges, without runs of fewer than ``least`` words."""

    def put(state: Column) -> Column:
        return F.when(state["e"] - state["s"] >= least, F.concat(state["out"], _range(state["s"], state["e"]))).otherwise(state["out"])

    def add(state: Column, x: Column) -> Column:
        longer = F.struct(state["s"].alias("s"), F.greatest(state["e"], x["e"]).alias("e"), state["out"].alias("out"))
        return F.when(x["s"] <= state["e"], longer).otherwise(F.struct(x["s"].alias("s"), x["e"].alias("e"), put(state).alias("out")))

    return F.aggregate(F.sort_array(ranges), F.struct(F.lit(0).alias("s"), F.lit(-1).alias("e"), F.array().cast(_RANGES).alias("out")), add, put)


def without(text: Column, gone: Column) -> Column:
    """text without the word ranges gone and the white space behind them."""
    lead = text.rlike(r"^[\x09-\x0D ]").cast("int")

    def kept(t: Column) -> Column:
        def piece(k: Column) -> Column:
            a = F.when(k == 0, F.lit(0)).otherwise(lead + F.get(gone, k - 1)["e"])
            b = F.when(k == F.size(gone), F.size(t)).otherwise(lead + F.get(gone, k)["s"])
            return F.slice(t, a + 1, b - a)

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), piece)), "")

    return F.when(F.size(gone) > 0, _let(F.split(text, _EDGE), kept)).otherwise(text)


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, piece: int = PIECE, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """docs with the repeated runs deleted from text, and __bq_runs (their number) beside it."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    pairs = anchors(docs, gram, window)
    parts = earlier_parts(docs, pairs, gram).withColumnsRenamed({"doc_id": "__bq_id", _TH: "__bq_gth"})
    ids = pairs.select(F.col("doc_id").alias("k")).distinct()
    split = _maybe(docs, F.col("doc_id").cast("long"), _marks(ids, ids.count()))
    alone = split.filter(~F.col("__bq_in")).select(*columns, F.lit(0).alias("__bq_runs"))
    own = split.filter("__bq_in").select(*columns)
    met = own.join(parts, (own["doc_id"].cast("long") == parts["__bq_id"]) & (F.hash(own["text"]) == parts["__bq_gth"]), "left").select(*columns, "__bq_parts")
    gone = _let(word_hashes(F.col("text").cast("string")), lambda h: runs(covered(h, F.col("__bq_parts"), gram, piece), min_words))
    # exploded, not selected: no later filter or use repeats the work
    found = met.select(*columns, F.explode(F.array(F.when(F.col("__bq_parts").isNotNull(), gone))).alias("__bq_gone"))
    text = F.when(F.size("__bq_gone") > 0, without(F.col("text").cast("string"), F.col("__bq_gone"))).otherwise(F.col("text"))
    cut = found.select(*columns, F.explode(F.array(text)).alias("__bq_left"), F.greatest(F.lit(0), F.coalesce(F.size("__bq_gone"), F.lit(0))).alias("__bq_runs"))
    cut = cut.select(*[F.col("__bq_left").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], "__bq_runs")
    return cut.unionByName(alone)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text that is left, and the runs deleted from it."""
    out = dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.col("__bq_runs").alias("n_runs"))
