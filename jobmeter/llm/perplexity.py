"""Quality rules with the perplexity of a modified Kneser-Ney n-gram model.

The model's symbols are characters, one model per language. Tasks count the n-grams of whole texts
and combine them before anything is shuffled; Spark then derives the lower orders (continuation
counts), discounts, contexts and interpolated probabilities with joins and aggregates over distinct
n-grams. Every n-gram of a scored text is in the model, because the model counts all documents; it
is stored as shards of sorted hashes with their log probabilities.

If the model's counted size is within ``BROADCAST_NGRAMS``, tasks hold it and look texts up directly.
Beyond that, documents are dealt into slices, a slice sends its distinct hashes to the shards, and
the answers meet the slice again: what moves is texts, and one hash and one number for each distinct
n-gram of a slice.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobmeter.llm import words
from jobmeter.llm.tables import batch, bounded_batches, col, packed, tidy, unpacked
from jobmeter.operators.lookups import small_side
from jobmeter.session import materialize

ORDER = 5
EDGE = "\n"  # pads the start of a text, so that its first characters have a context
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of words in repeated three-word windows
DEVIATIONS = (6.0, 3.5)  # width of the band below and above the median
BIN = 1e-4  # resolution of log perplexities, and
SCALED_BIN = 1e-2  # of their distances to the median times the root of a text's length
LEAST_SPREAD = 0.05  # of those, where all texts are alike
SPREAD_ERROR = 3.5  # three standard errors of a median deviation, times the root of the number of texts
BROADCAST_NGRAMS = 4_000_000
NGRAMS_PER_SHARD = 1 << 20
SLICE_BYTES = 1 << 25
PROBE_BYTES = 1 << 27  # hashes that a shard answers in one go
HELD_NGRAMS = 1 << 19  # distinct n-grams that a task holds before it sends them off

SYMBOLS = "#*$%&|<>"


def _points(data: np.ndarray) -> np.ndarray:
    """Code points of UTF-8 bytes, with U+FFFD for U+0000, which ends texts in numpy."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return np.where(points == 0, np.uint32(0xFFFD), points)


def _grams(data: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, padded code points, end position) of every n-gram of a slice of texts."""
    points = _points(data)
    starts = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=starts[1:])
    first = starts[bounds]
    rows = len(bounds) - 1
    row = np.repeat(np.arange(rows), np.diff(first))
    pad = order - 1
    padded = np.full(len(points) + pad * rows, ord(EDGE), np.uint32)
    place = np.arange(len(points)) + pad * (row + 1)
    padded[place] = points
    return row, padded, place


def _gram_hashes(padded: np.ndarray, place: np.ndarray, order: int) -> np.ndarray:
    total = np.zeros(len(place), np.uint64)
    for k in range(order):
        total = total * np.uint64(0x9E3779B97F4A7C55) + padded[place - order + 1 + k].astype(np.uint64) + np.uint64(1)
    return words.mix(total)


def _language_salt(lang: str) -> np.uint64:
    data = np.frombuffer(lang.encode() or b"\0", np.uint8)
    return words.span_hashes(data, np.array([0]), np.array([len(data)]))[0]


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(hashes, counts, languages, code points) with every hash once."""
    hashes, counts, langs, grams = (np.concatenate(x) for x in zip(*parts))
    known, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    return known, np.bincount(inverse, counts).astype(np.int64), langs[first], grams[first]


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"lang": pa.string(), "gram": pa.string(), "n": pa.int64()}
        names: list[str] = []
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            _, counts, langs, grams = _merged(held)
            held.clear()
            texts = np.ascontiguousarray(grams, "<u4").view(f"<U{order}").reshape(-1)
            for a in range(0, len(counts), 1 << 16):
                part = slice(a, a + (1 << 16))
                values = pa.array(names).take(pa.array(langs[part]))
                yield batch({"lang": values, "gram": pa.array(texts[part]), "n": counts[part]}, kinds)

        for given in batches:
            langs = given["lang"].to_pylist()
            names += sorted(set(langs) - set(names))
            code = np.array([names.index(x) for x in langs], np.int32)
            salts = np.array([_language_salt(x) for x in names], np.uint64)
            for first, data, bounds in words.slices(given["text"]):
                row, padded, place = _grams(data, bounds, order)
                lang = code[first + row]
                hashes = _gram_hashes(padded, place, order) ^ salts[lang]
                known, at, counts = np.unique(hashes, return_index=True, return_counts=True)
                window = place[at][:, None] + np.arange(1 - order, 1)
                held.append((known, counts, lang[at], padded[window]))
                if sum(len(part[0]) for part in held) >= 2 * HELD_NGRAMS:
                    held[:] = [_merged(held)]
                    if len(held[0][0]) >= HELD_NGRAMS:
                        yield from flush()
        if held:
            yield from flush()

    return run


def count_ngrams(docs: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n) of all n-grams of (lang, text) rows, each text padded at its start."""
    counted = docs.select("lang", "text").mapInArrow(tidy(_count(order)), "lang string, gram string, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(table: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3) after Chen and Goodman; where a count of counts is missing, 0.5, 1 and 1.5."""
    n = {k: F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)}
    counted = table.groupBy("lang").agg(*[c.cast("double").alias(f"n{k}") for k, c in n.items()])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def discount(k: int, default: float) -> Column:
        value = k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")
        known = (F.col("n1") > 0) & (F.col(f"n{k}") > 0) & (F.col(f"n{k + 1}") > 0)
        return F.when(known & (value > 0), value).otherwise(F.lit(default)).alias(f"d{k}")

    return counted.select("lang", discount(1, 0.5), discount(2, 1.0), discount(3, 1.5))


def kneser_ney(counts: DataFrame, order: int) -> DataFrame:
    """(lang, gram, logp) with the interpolated modified Kneser-Ney probability of each n-gram.

    ``logp`` is the natural logarithm of the probability of the last symbol after the others.
    """
    tables = {order: counts}
    for k in range(order - 1, 0, -1):
        shorter = F.expr(f"substring(gram, 2, {k})")
        tables[k] = materialize(
            tables[k + 1].groupBy("lang", shorter.alias("gram")).agg(F.count("*").alias("n")), "ngrams"
        )
    base = tables[1].groupBy("lang").agg((1.0 / F.count("*")).alias("lower"))
    known: DataFrame | None = None
    for k in range(1, order + 1):
        cut = _discounts(tables[k])
        n = F.col("n")
        context = F.expr(f"substring(gram, 1, {k - 1})").alias("context")
        contexts = tables[k].groupBy("lang", context).agg(
            F.sum("n").cast("double").alias("total"),
            *[F.count_if(c).alias(f"m{i}") for i, c in ((1, n == 1), (2, n == 2), (3, n >= 3))],
        )
        contexts = contexts.join(small_side(cut), "lang")
        entry = tables[k].select("lang", "gram", "n", context, F.expr(f"substring(gram, 2, {k - 1})").alias("tail"))
        entry = entry.join(contexts, ["lang", "context"])
        if known is None:
            entry = entry.join(small_side(base), "lang")
        else:
            entry = entry.join(known.select("lang", F.col("gram").alias("tail"), F.col("p").alias("lower")), ["lang", "tail"])
        taken = F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
        spared = F.col("d1") * F.col("m1") + F.col("d2") * F.col("m2") + F.col("d3") * F.col("m3")
        p = (F.greatest(n - taken, F.lit(0.0)) + spared * F.col("lower")) / F.col("total")
        known = materialize(entry.select("lang", "gram", p.alias("p")), "ngram-model")
    return known.select("lang", "gram", F.ln("p").alias("logp"))


def _hashed(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"hash": pa.int64(), "logp": pa.float32()}
        for given in batches:
            points = np.frombuffer("".join(given["gram"].to_pylist()).encode("utf-32-le"), np.uint32)
            langs = given["lang"].to_pylist()
            salt_of = {x: _language_salt(x) for x in set(langs)}
            salts = np.array([salt_of[x] for x in langs], np.uint64)
            place = np.arange(order - 1, len(points), order)
            hashes = _gram_hashes(points, place, order) ^ salts
            yield batch({"hash": hashes.view(np.int64), "logp": given["logp"].to_numpy().astype(np.float32)}, kinds)

    return run


def _shard_arrays(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    hashes = group["hash"].to_numpy().view(np.uint64)
    at = np.argsort(hashes)
    logp = group["logp"].to_numpy(np.float32)[at]
    return pd.DataFrame({"shard": [key[0]], "hashes": [hashes[at].tobytes()], "logp": [logp.tobytes()]})


def model_shards(model: DataFrame, order: int, shards: int) -> DataFrame:
    """(shard, hashes, logp): sorted 64-bit hashes and their 32-bit log probabilities."""
    hashed = model.select("lang", "gram", "logp").mapInArrow(_hashed(order), "hash long, logp float")
    return (
        hashed.withColumn("shard", F.pmod("hash", F.lit(shards)).cast("int"))
        .groupBy("shard")
        .applyInPandas(_shard_arrays, "shard int, hashes binary, logp binary")
    )


class Lookup:
    """Sorted hashes and log probabilities of a whole model or of the n-grams of a slice.

    A table over the leading bits points near each hash, so that a look-up is a step or two.
    """

    def __init__(self, parts: list[tuple[bytes, bytes]]) -> None:
        hashes = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(h, np.uint64) for h, _ in parts)])
        logp = np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(p, np.float32) for _, p in parts)])
        order = np.argsort(hashes)
        self.hashes, self.logp = hashes[order], logp[order]
        bits = max(1, int(len(hashes)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        last = len(self.hashes) - 1
        place = np.minimum(self.starts[wanted >> self.shift], last)
        open_ = np.flatnonzero(self.hashes[place] != wanted)
        while len(open_):
            if (self.hashes[place[open_]] > wanted[open_]).any() or (place[open_] == last).any():
                raise RuntimeError("an n-gram is not in the model that counted it")
            place[open_] += 1
            open_ = open_[self.hashes[place[open_]] != wanted[open_]]
        return self.logp[place].astype(np.float64)


def _slice_scores(data: np.ndarray, bounds: np.ndarray, salts: np.ndarray, order: int, lookup: Lookup) -> tuple[np.ndarray, np.ndarray]:
    """(sum of log probabilities, characters) of each row."""
    rows = len(bounds) - 1
    row, padded, place = _grams(data, bounds, order)
    if not len(row):
        return np.zeros(rows), np.zeros(rows, np.int64)
    logp = lookup(_gram_hashes(padded, place, order) ^ salts[row])
    return np.bincount(row, logp, rows), np.bincount(row, minlength=rows)


def base_statistics(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row, and its mark.

    The mark is the smallest hash of a three-word window (0 without one). Equal texts have equal marks,
    near copies mostly, other texts seldom.
    """
    rows = len(bounds) - 1
    found = words.words(data, bounds)
    n_words = np.bincount(found.row, minlength=rows)
    chars = np.bincount(found.row, words.code_points(data, found.start, found.end), rows).astype(np.int64)
    is_symbol = np.zeros(256, bool)
    is_symbol[[ord(c) for c in SYMBOLS]] = True
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(is_symbol[data], out=total[1:])
    symbols = total[bounds[1:]] - total[bounds[:-1]]

    parts = words.lines(data, bounds)
    start, end = words.strip(data, parts)
    some = end > start
    key = words.span_hashes(data, parts.start, parts.end)[some]
    row = parts.row[some]
    order = np.lexsort((key, row))
    again = (row[order][1:] == row[order][:-1]) & (key[order][1:] == key[order][:-1])
    dup_lines = np.bincount(row[order][1:][again], minlength=rows)

    repeated = np.zeros(len(found.row), bool)
    mark = np.full(rows, np.iinfo(np.uint64).max)
    if len(found.row) >= 3:
        weight = [np.uint64(w) for w in (0x9FB21C651E98DF25, 0x8CB92BA72F3D8DD7, 0xD1342543DE82EF95)]
        window = sum(found.hash[k : len(found.hash) - 2 + k] * weight[k] for k in range(3))
        whole = np.flatnonzero(found.row[:-2] == found.row[2:])
        np.minimum.at(mark, found.row[whole], words.mix(window[whole]))
        order = whole[np.lexsort((window[whole], found.row[whole]))]
        same = (found.row[order][1:] == found.row[order][:-1]) & (window[order][1:] == window[order][:-1])
        often = order[np.r_[False, same] | np.r_[same, False]] if len(order) else order
        for k in range(3):
            repeated[often + k] = True
    repeat_words = np.bincount(found.row[repeated], minlength=rows)
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat_words, "mark": np.where(mark == np.iinfo(np.uint64).max, np.uint64(0), mark).view(np.int64)}


_STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_COUNTS = (*_STATISTICS, "mark")
_SCORES = "logp double, chars long, " + ", ".join(f"{c} long" for c in _COUNTS)


def _scored_batches(given: pa.Table | pa.RecordBatch, order: int, lookup: Lookup) -> Iterator[dict[str, np.ndarray]]:
    names = given["lang"].to_pylist()
    salt_of = {x: _language_salt(x) for x in set(names)}
    salts = np.array([salt_of[x] for x in names], np.uint64)
    for first, data, bounds in words.slices(given["text"]):
        rows = len(bounds) - 1
        logp, chars = _slice_scores(data, bounds, salts[first : first + rows], order, lookup)
        yield {"logp": logp, "chars": chars} | base_statistics(data, bounds)


def _score_all(order: int, model_: object):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(model_.value)
        kinds = {"logp": pa.float64(), "chars": pa.int64()} | dict.fromkeys(_COUNTS, pa.int64())
        for given in batches:
            done = 0
            for values in _scored_batches(given, order, lookup):
                out = batch(values, kinds)
                row = given["row"].slice(done, out.num_rows)
                done += out.num_rows
                yield pa.RecordBatch.from_arrays(
                    [*out.columns, given["lang"].slice(done - out.num_rows, out.num_rows), row],
                    schema=pa.schema([*out.schema, given.schema.field("lang"), given.schema.field("row")]),
                )

    return run


def score(keyed: DataFrame, shards: DataFrame, shard_count: int, ngrams: int, order: int) -> DataFrame:
    """(lang, row, logp, chars, statistics) of rows (lang, text, row)."""
    kind = keyed.schema["row"].dataType.simpleString()
    schema = f"{_SCORES}, lang string, row {kind}"
    if ngrams <= BROADCAST_NGRAMS:
        parts = [(bytes(r["hashes"]), bytes(r["logp"])) for r in shards.select("hashes", "logp").collect()]
        model_ = keyed.sparkSession.sparkContext.broadcast(parts)
        return keyed.mapInArrow(tidy(_score_all(order, model_)), schema)
    return _score_by_slices(keyed, shards, shard_count, order, schema)


def _slice_probes(order: int, shards: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        names = rows["lang"].to_pylist()
        salt_of = {x: _language_salt(x) for x in set(names)}
        salts = np.array([salt_of[x] for x in names], np.uint64)
        found = np.zeros(0, np.uint64)
        for first, data, bounds in words.slices(rows["text"]):
            row, padded, place = _grams(data, bounds, order)
            here = _gram_hashes(padded, place, order) ^ salts[first + row]
            found = np.union1d(found, here)
        shard = found.view(np.int64) % shards
        used = np.unique(shard)
        kinds = {"slice": pa.int64(), "shard": pa.int32(), "hashes": pa.binary()}
        parts = [found[shard == s].tobytes() for s in used]
        slice_ = np.full(len(used), key[0].as_py(), np.int64)
        return pa.Table.from_batches([batch({"slice": slice_, "shard": used.astype(np.int32), "hashes": parts}, kinds)])

    return run


def _shard_answers(probes: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
    lookup = Lookup(list(zip(shard["hashes"], shard["logp"])))
    logp = [lookup(np.frombuffer(h, np.uint64)).astype(np.float32).tobytes() for h in probes["hashes"]]
    return pd.DataFrame({"slice": probes["slice"], "hashes": probes["hashes"], "logp": logp})


def _slice_rows(order: int):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        lookup = Lookup(list(zip(answers["hashes"].to_pylist(), answers["logp"].to_pylist())))
        kinds = {"logp": pa.float64(), "chars": pa.int64()} | dict.fromkeys(_COUNTS, pa.int64())
        scored = pa.Table.from_batches(
            [batch(values, kinds) for values in _scored_batches(rows, order, lookup)],
            schema=pa.schema(list(kinds.items())),
        )
        return scored.append_column("lang", rows["lang"]).append_column("row", rows["row"])

    return run


def _score_by_slices(
    keyed: DataFrame, shards: DataFrame, shard_count: int, order: int, schema: str
) -> DataFrame:
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = size // SLICE_BYTES + 1
    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(slices))
    dealt = materialize(keyed.withColumn("slice", number), "slices")  # numbers must not change between uses
    probes = materialize(
        dealt.groupBy("slice").applyInArrow(_slice_probes(order, shard_count), "slice long, shard int, hashes binary"),
        "probes",
    )
    # Each wave gets a copy of the model's shards: no more waves than the size of the probes asks for.
    asked = probes.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0
    waves = min(slices, asked // (shard_count * PROBE_BYTES) + 1)
    probes = probes.withColumn("wave", F.pmod("slice", F.lit(waves)))
    each_wave = shards.withColumn("wave", F.explode(F.sequence(F.lit(0), F.lit(waves - 1)).cast("array<long>")))
    answers = (
        probes.groupBy("shard", "wave")
        .cogroup(each_wave.groupBy("shard", "wave"))
        .applyInPandas(_shard_answers, "slice long, hashes binary, logp binary")
    )
    return (
        dealt.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(_slice_rows(order), schema)
    )


def _middle(table: DataFrame, value: Column, step: float) -> DataFrame:
    """(lang, middle, total): the lower median of binned values; the windows run over bins, not rows."""
    bins = table.groupBy("lang", F.round(value / step).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("lang").orderBy("bin"))
    total = F.sum("n").over(W.partitionBy("lang"))
    placed = bins.withColumn("upto", upto).withColumn("total", total).where(2 * F.col("upto") >= F.col("total"))
    return placed.groupBy("lang").agg((F.min("bin") * step).alias("middle"), F.max("total").alias("total"))


def judge(
    docs: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    order: int = ORDER,
    min_words: int = MIN_WORDS,
    max_repeated: int = MAX_REPEATED,
    deviations: tuple[float, float] = DEVIATIONS,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Every row of ``docs`` with the base statistics, base_failed, perplexity and kept.

    A text fails the base rules with fewer than ``min_words`` words or with more than
    ``max_repeated`` per cent of its words in repeated three-word windows. Of the others, those are
    kept whose log perplexity lies within ``deviations`` deviations below and above the median of
    their language. The mean over a text's characters scatters with the root of their number, so
    distances to the median are multiplied by it, and a language's deviation is their median (scaled
    to a standard deviation): the band is wide for short texts and narrow for long ones. It is wider
    by the uncertainty of that deviation where a language has few texts. Texts with
    the same smallest hash of three words are one text for the median and the deviation, with their
    least perplexity, so that copies and near copies of a document do not set the band.

    Null or empty text has no words, fails, and has no perplexity. Null language is a language of
    its own. Repeated rows count one by one and get equal results. Result columns replace columns of
    the same name; others pass through (``keep`` names those that do, where not all are wanted). An
    empty table gives an empty table.
    """
    kept = docs.columns if keep is None else list(keep)
    keyed = packed(bounded_batches(docs), kept, lang=F.coalesce(col(lang).cast("string"), F.lit("")), text=F.coalesce(col(text).cast("string"), F.lit("")))
    counts = materialize(count_ngrams(keyed, order), "ngrams")
    ngrams = counts.count()
    shard_count = max(8, -(-ngrams // NGRAMS_PER_SHARD))
    shards = materialize(model_shards(kneser_ney(counts, order), order, shard_count), "ngram-shards")
    scored = materialize(
        score(keyed, shards, shard_count, ngrams, order)
        .withColumn("bits", F.when(F.col("chars") > 0, -F.col("logp") / F.col("chars")))
        .withColumn(
            "base_failed",
            (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words")),
        ),
        "scored",
    )
    sound = scored.where(~F.col("base_failed")).groupBy("lang", "mark").agg(
        F.min(F.struct("bits", "chars")).alias("least")
    )
    sound = materialize(sound.select("lang", "least.*"), "different-texts")
    middle = materialize(_middle(sound, F.col("bits"), BIN), "middles")
    distance = (F.col("bits") - F.col("middle")) * F.sqrt("chars")
    spread = _middle(sound.join(small_side(middle), "lang"), F.abs(distance), SCALED_BIN)
    spread = spread.select("lang", F.col("middle").alias("spread"))
    bands = materialize(middle.join(spread, "lang"), "bands")
    deviation = distance / (1.4826 * F.greatest(F.col("spread"), F.lit(LEAST_SPREAD)))
    wider = 1 + SPREAD_ERROR / F.sqrt("total")
    inside = deviation.between(-deviations[0] * wider, deviations[1] * wider)
    judged = scored.join(small_side(bands), "lang", "left")
    return unpacked(
        judged,
        kept,
        {c: F.col(c) for c in _STATISTICS}
        | {
            "perplexity": F.exp("bits"),
            "deviation": deviation,
            "base_failed": F.col("base_failed"),
            "kept": ~F.col("base_failed") & F.coalesce(inside, F.lit(False)),
        },
    )
