"""Quality classifier: an interpolated modified Kneser-Ney trigram model of trusted text."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import partial, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import mapped
from .labelled import labelled_sample
from .shared import by_bytes, cuts, drop, free_name, give_back, in_arrow, plain, scratch_path, small_batches, written
from .words import INKED, SAME, U, mix, words

#: Labelled good documents of a language used at most, None for all; of every three, two train the model and one sets
#: the threshold.
ROWS: int | None = None
#: Share of trusted held-out documents of a language that score at most its threshold; least number of them to set one.
QUANTILE, LEAST = 0.999, 20
#: Words of average text that a document's own are averaged with, so that short texts aren't judged on a word or two.
PRIOR = 20
#: Bytes of trusted text a shard of n-grams is meant for; bits of a middle word's hash that choose the shard at least;
#: how many fewer choose a part of the words.
SHARD_BYTES, LEAST_BITS, FEWER = 6 << 20, 3, 2
#: Bytes of text that a worker looks at together; words whose trigrams a task counts before it hands them on.
AT_ONCE, GATHERED = 1 << 19, 1 << 19
#: Passes over the trusted text that exchange a share of the shards each, if there are more than the least number:
#: what lies on disk between map and reduce is that share only.
PASSES = 4

_START = mix(np.array([0x5DEECE66D], U))[0]
_MODELS: dict[str, Shards] = {}


class Model(NamedTuple):
    path: str  # folder of the shards of n-grams
    unknown: dict[str, float]  # log probability of a word never seen, by language


def _salts(langs: list[str | None]) -> np.ndarray:
    known = {x: int.from_bytes(hashlib.blake2b((x or "").encode(), digest_size=8).digest(), "little") for x in set(langs)}
    return mix(np.array([known[x] for x in langs], U))


def grams(texts: pa.Array, langs: list[str | None]) -> tuple[np.ndarray, ...]:
    """For each word of the texts: its text, and the hashed 1-, 2- and 3-grams that end in it, the 1- and 2-gram
    before it and the word before that. Languages share no gram; two start marks come before each text."""
    w = words(texts, INKED, SAME)
    n = len(w.doc)
    salt = _salts(langs)[w.doc] if n else np.zeros(0, U)
    one = mix(w.hash ^ salt)
    nth = np.arange(n) - np.searchsorted(w.doc, w.doc)
    start = mix(salt ^ _START)
    before = np.where(nth > 0, np.append(U(0), one[:-1])[:n], start)
    two = mix(before * U(3) + one)
    first = np.where(nth > 1, np.append(np.zeros(2, U), one[:-2])[:n], start)
    before2 = mix(first * U(3) + before)
    three = mix(before2 * U(5) + one)
    return w.doc, one, two, three, before, before2, first


def shard_of(middle: np.ndarray, bits: int) -> np.ndarray:
    return (middle >> U(64 - bits)).astype(np.int64)


def _cut(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin in a sorted array."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)


def _narrow(numbers: np.ndarray) -> np.ndarray:
    """Numbers from 0 in the narrowest type that holds them all."""
    return numbers.astype(np.min_scalar_type(int(numbers.max()) if len(numbers) else 0))


def _wide(data: bytes, n: int) -> np.ndarray:
    """``n`` numbers that were made narrow."""
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


_COUNTED = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("words", pa.binary()), ("places", pa.binary()), ("count", pa.binary())])


def _counted(bits: int, passes: int, now: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigrams of the shards of this pass by shard of their middle word and language, distinct among those gathered:
    the words that they are of, three places in these for each trigram, its count. All else follows from these."""
    names: dict[str, int] = {}
    held: list[tuple[np.ndarray, ...]] = []
    for batch in by_bytes(batches, "text", AT_ONCE):
        langs = batch.column("lang").to_pylist()
        doc, one, _, three, before, _, first = grams(batch.column("text"), langs)
        arrays = three, first, before, one, np.array([names.setdefault(x, len(names)) for x in langs], np.int64)[doc]
        held.append(arrays if passes == 1 else tuple(x[own] for own in [shard_of(before, bits) % passes == now] for x in arrays))
        if sum(len(x[0]) for x in held) >= GATHERED:
            yield _handed_on(bits, list(names), held)
            held = []
    if any(len(x[0]) for x in held):
        yield _handed_on(bits, list(names), held)


def _handed_on(bits: int, names: list[str], held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    three, *own, lang = (np.concatenate(x) for x in zip(*held))
    _, at, count = np.unique(three, return_index=True, return_counts=True)
    group = shard_of(own[1][at], bits) * len(names) + lang[at]
    order = np.lexsort((own[1][at], group))
    at, count, group, rows = at[order], count[order], group[order], []
    edges = np.append(_cut(group), len(group)).tolist()
    for i, j in zip(edges[:-1], edges[1:]):
        known, places = np.unique(np.concatenate([x[at[i:j]] for x in own]), return_inverse=True)
        g = int(group[i])
        rows.append((g // len(names), names[g % len(names)], j - i, known.tobytes(), _narrow(places).tobytes(), _narrow(count[i:j]).tobytes()))
    return pa.RecordBatch.from_pylist([dict(zip(_COUNTED.names, r)) for r in rows], _COUNTED)


def _classes(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()


class _Shard(NamedTuple):
    """Distinct trigrams of one shard and language, and their bigrams: everything about a middle word is in one shard."""

    three: np.ndarray  # keys of the trigrams, ascending
    context: np.ndarray
    count: np.ndarray
    two: np.ndarray  # keys of the bigrams, ascending
    two_last: np.ndarray
    two_middle: np.ndarray
    two_count: np.ndarray  # distinct words before the bigram


def _sharded(first: np.ndarray, middle: np.ndarray, last: np.ndarray, count: np.ndarray) -> _Shard:
    context = mix(first * U(3) + middle)
    three = mix(context * U(5) + last)
    order = np.argsort(three)
    three = three[order]
    at = _cut(three)
    count = np.add.reduceat(count[order], at) if len(at) else np.zeros(0, np.int64)
    order = order[at]
    middle, last = middle[order], last[order]
    two, own, n = np.unique(mix(middle * U(3) + last), return_index=True, return_counts=True)
    return _Shard(three[at], context[order], count, two, last[own], middle[own], n)


def discounts(n1: int, n2: int, n3: int, n4: int) -> Discounts:
    """D1, D2 and D3+ from the numbers of grams that occur once to four times."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.75, 3 - 4 * y * n4 / n3 if n3 else 0.9)
    return tuple(min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1))


class _Language(NamedTuple):
    d1: Discounts
    d2: Discounts
    d3: Discounts
    total: int  # distinct bigrams
    base: float  # probability of each word never seen


def _within(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct contexts, for each the total of its grams' counts and how many grams count 1, 2 and more)."""
    own, which = np.unique(keys, return_inverse=True)
    kind = np.bincount(which * 4 + np.minimum(counts, 3), minlength=4 * len(own)).reshape(-1, 4)
    kind[:, 0] = np.bincount(which, counts, len(own))
    return own, kind


def _lookup(name: str, keys: np.ndarray, facts: np.ndarray, shift: int = 0) -> dict[str, np.ndarray]:
    """A file's arrays of sorted keys with a row of numbers each.

    A directory by the keys' first bits says where keys begin, which are kept without these. Few rows of numbers
    differ, so a key has the place of its own in a table of them, in which row 0 stands for keys that aren't there.
    """
    keys = keys << U(shift)
    order = np.argsort(keys)
    keys, size = keys[order], int(len(keys)).bit_length()
    bits = max(1, size - 4, min(16, size - 1))
    held = np.bincount((keys >> U(64 - bits)).astype(np.int64), minlength=1 << bits)
    starts = np.append(0, np.cumsum(held)).astype(np.int32 if len(keys) < 1 << 31 else np.int64)
    rest = keys & ((U(1) << U(64 - bits)) - U(1))
    code = np.zeros(len(keys), np.int64)
    for column in facts.T:
        code = np.unique(code * (int(column.max(initial=0)) + 1) + column, return_inverse=True)[1]
    _, at = np.unique(code, return_index=True)
    table = np.concatenate([np.zeros((1, facts.shape[1]), np.int64), facts[at]])
    arrays = {"starts": starts, "low": rest.astype(np.uint32), "high": _narrow(rest >> U(32)), "codes": _narrow(code[order] + 1), "table": table.ravel(), "most": held.max(keepdims=True)}
    return {f"{name}.{k}": v for k, v in arrays.items()}


_CLASSES = [pa.field(f"{k}{i}", pa.int64()) for k in ("three", "two") for i in range(4)]
_WORDS = pa.schema([("part", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("words", pa.binary()), ("befores", pa.binary()), *_CLASSES])
_SUMMED = pa.schema([("lang", pa.string()), *((f"one{i}", pa.int64()) for i in range(4)), ("total", pa.int64()), ("kinds", pa.int64())])
#: Numbers of each n-gram's row: its count, or of a context what ``_within`` says.
_LOOKUPS = {"three": 1, "context": 4, "two": 1, "middle": 4}


def _filed(folder: str, bits: int, key: tuple, table: pa.Table) -> pa.Table:
    """Writes one shard's sorted n-grams of all languages, with their directories, as a file for workers to map. Left
    to sum across shards are, by language, counts of counts and how many distinct words come before each word."""
    found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {name: [] for name in _LOOKUPS}
    rows, langs = [], np.array(table.column("lang").to_pylist(), object)
    for lang in sorted(set(langs)):
        own = [[], [], [], []]
        for r in table.take(np.flatnonzero(langs == lang)).to_pylist():
            places = np.frombuffer(r["words"], U)[_wide(r["places"], 3 * r["n"])].reshape(3, -1)
            for held, x in zip(own, (*places, _wide(r["count"], r["n"]))):
                held.append(x)
        s = _sharded(*(np.concatenate(x) for x in own))
        del own
        found["three"].append((s.three, s.count[:, None]))
        found["context"].append(_within(s.context, s.count))
        found["two"].append((s.two, s.two_count[:, None]))
        found["middle"].append(_within(s.two_middle, s.two_count))
        known, n = np.unique(s.two_last, return_counts=True)
        classes = dict(zip((f.name for f in _CLASSES), _classes(s.count) + _classes(s.two_count)))
        part = shard_of(known, bits - FEWER)
        edges = np.append(_cut(part), len(part)).tolist()
        for i, j in zip(edges[:-1], edges[1:]):
            rows.append({"part": int(part[i]), "lang": lang, "n": j - i, "words": known[i:j].tobytes(), "befores": _narrow(n[i:j]).tobytes()} | classes)
            classes = {}
    # middle words of a shard share their first bits, which the directory leaves out
    arrays = [_lookup(name, *(np.concatenate(x) for x in zip(*own)), bits if name == "middle" else 0) for name, own in found.items()]
    mapped.save(f"{folder}/{key[0].as_py()}", {k: v for x in arrays for k, v in x.items()})
    return pa.Table.from_pylist(rows, _WORDS)


def _words_filed(folder: str, bits: int, key: tuple, table: pa.Table) -> pa.Table:
    """Writes a part of the words, with how many distinct words come before each, as a file; by language, the counts of
    those counts, their total and how many words there are."""
    found, rows, langs = [], [], np.array(table.column("lang").to_pylist(), object)
    for lang in sorted(set(langs)):
        own = table.take(np.flatnonzero(langs == lang)).to_pylist()
        known, which = np.unique(np.concatenate([np.frombuffer(r["words"], U) for r in own]), return_inverse=True)
        n = np.bincount(which, np.concatenate([_wide(r["befores"], r["n"]) for r in own]), len(known)).astype(np.int64)
        found.append((known, n[:, None]))
        rows.append(dict(zip(_SUMMED.names, (lang, *_classes(n), int(n.sum()), len(n)))))
    mapped.save(f"{folder}/w{key[0].as_py()}", _lookup("words", *(np.concatenate(x) for x in zip(*found)), bits - FEWER))
    return pa.Table.from_pylist(rows, _SUMMED)


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} { {'int64': 'bigint'}.get(str(f.type), f.type)}" for f in schema)


def _summed(df: DataFrame, names: list[str]) -> dict[str, dict[str, int]]:
    return {r["lang"]: r.asDict() for r in df.groupBy("lang").agg(*[F.sum(c).alias(c) for c in names]).collect()}


def train(trusted: DataFrame) -> Model:
    """The model of ``trusted``(text, lang), all of it.

    Trigram counts meet in shards by middle word, as many as the text needs for each to fit a task. A shard has all of
    its trigrams' contexts and lower orders, so that these joins need no further exchange; only the words' own counts
    are summed across shards. Files keep counts; probabilities are worked out when they are looked up.
    """
    spark = trusted.sparkSession
    trusted = trusted.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    size = trusted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(LEAST_BITS, (size // SHARD_BYTES).bit_length())
    folder = scratch_path(spark, "kn")

    def filed(key: tuple, table: pa.Table) -> pa.Table:
        return _filed(folder, bits, key, table)

    def words_filed(key: tuple, table: pa.Table) -> pa.Table:
        return _words_filed(folder, bits, key, table)

    passes, counted = PASSES if bits > LEAST_BITS else 1, []
    for now in range(passes):
        rows = in_arrow(trusted, partial(_counted, bits, passes, now), _ddl(_COUNTED))
        counted.append(written(rows.groupBy("shard").applyInArrow(filed, _ddl(_WORDS)), "kn-counts", exchanged=False))
    counts = reduce(DataFrame.unionByName, [df for df, _ in counted])
    unigrams, words_path = written(counts.select("part", "lang", "n", "words", "befores").groupBy("part").applyInArrow(words_filed, _ddl(_SUMMED)), "kn-words", exchanged=False)
    ones, more = _summed(unigrams, _SUMMED.names[1:]), _summed(counts, [f.name for f in _CLASSES])
    for done in (*(path for _, path in counted), words_path):
        drop(spark, done)
    languages = {}
    for lang, r in ones.items():
        d1, d2, d3 = (discounts(*(x[f"{k}{i}"] for i in range(4))) for k, x in (("one", r), ("two", more[lang]), ("three", more[lang])))
        n1, n2 = r["one0"], r["one1"]
        freed = d1[0] * n1 + d1[1] * n2 + d1[2] * (r["kinds"] - n1 - n2)
        languages[lang] = _Language(d1, d2, d3, r["total"], freed / r["total"] / (r["kinds"] + 1))
    arrays = {"names": np.frombuffer(json.dumps(list(languages)).encode(), np.uint8), "bits": np.array([bits])}
    arrays["discounts"] = np.array([x for v in languages.values() for d in v[:3] for x in (0.0, *d)], np.float64)
    arrays["totals"] = np.array([v.total for v in languages.values()], np.float64)
    mapped.save(f"{folder}/languages", arrays)
    return Model(folder, {k: float(np.log(v.base)) for k, v in languages.items()})


class _Lookup:
    """Sorted keys with a row of numbers each; ``shift`` bits that all keys share are left out of the directory."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str, columns: int, shift: int = 0):
        self.shift, self.starts, self.low, self.high, self.codes = U(shift), *(arrays[f"{name}.{k}"] for k in ("starts", "low", "high", "codes"))
        self.table = arrays[f"{name}.table"].reshape(-1, columns)
        self.bits, self.steps = (len(self.starts) - 1).bit_length() - 1, int(arrays[f"{name}.most"][0]).bit_length()

    def _rest(self, at: np.ndarray) -> np.ndarray:
        return self.low[at] | self.high[at].astype(U) << U(32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, of zeros if it isn't there."""
        keys = keys << self.shift
        bucket, asked = (keys >> U(64 - self.bits)).astype(np.int64), keys & ((U(1) << U(64 - self.bits)) - U(1))
        at, stop, last = self.starts[bucket].astype(np.int64), self.starts[bucket + 1].astype(np.int64), len(self.low) - 1
        end = stop
        for _ in range(self.steps):  # halves every key's part of the array
            middle = (at + stop) >> 1
            less = (self._rest(np.minimum(middle, last)) < asked) & (at < stop)
            at, stop = np.where(less, middle + 1, at), np.where(less, stop, middle)
        there = np.minimum(at, last)
        return self.table[np.where((at < end) & (self._rest(there) == asked), self.codes[there], 0)]


class Shards(NamedTuple):
    bits: int
    words: list[_Lookup | None]
    by_middle: list[dict[str, _Lookup] | None]
    languages: dict[str, int]
    discounts: np.ndarray  # by language, order and count up to 3; the last are of a language not trained
    totals: np.ndarray


def _load(path: str) -> Shards:
    """The model's shards, mapped from their files, which all workers of a machine share."""
    if path not in _MODELS:
        _MODELS.clear()
        fs, inner = mapped.opened(path)
        there = {f.base_name for f in fs.get_file_info(pyarrow.fs.FileSelector(inner))}
        head = mapped.load(f"{path}/languages")
        bits = int(head["bits"][0])
        parts = [{k: _Lookup(arrays, k, n, bits if k == "middle" else 0) for k, n in _LOOKUPS.items()} if str(s) in there and (arrays := mapped.load(f"{path}/{s}")) else None for s in range(1 << bits)]
        known = [_Lookup(mapped.load(f"{path}/w{s}"), "words", 1, bits - FEWER) if f"w{s}" in there else None for s in range(1 << (bits - FEWER))]
        names = json.loads(head["names"].tobytes())
        d = np.concatenate([head["discounts"].reshape(-1, 3, 4), np.zeros((1, 3, 4))])
        _MODELS[path] = Shards(bits, known, parts, {x: i for i, x in enumerate(names)}, d, np.append(head["totals"], 1.0))
    return _MODELS[path]


def _met(which: np.ndarray, parts: list) -> Iterator[tuple]:
    """Each part that is there, with the places that ask for it."""
    order = np.argsort(which, kind="stable")
    edges = np.append(_cut(which[order]), len(order))
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if (part := parts[which[order[i]]]) is not None:
            yield part, order[i:j]


def log_probabilities(shards: Shards, unknown: dict[str, float], texts: pa.Array, langs: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, log probability) of each word, interpolated from its own, its bigram's and its trigram's counts.

    Words are joined with the counts shard by shard.
    """
    doc, one, two, three, before, before2, _ = grams(texts, langs)
    found = {k: np.zeros((len(doc), n), np.int64) for k, n in _LOOKUPS.items()} | {"one": np.zeros((len(doc), 1), np.int64)}
    for part, own in _met(shard_of(one, shards.bits - FEWER), shards.words):
        found["one"][own] = part.find(one[own])
    for part, own in _met(shard_of(before, shards.bits), shards.by_middle):
        for name, keys in (("three", three), ("context", before2), ("two", two), ("middle", before)):
            found[name][own] = part[name].find(keys[own])
    lang = np.array([shards.languages.get(x, -1) for x in langs], np.int64)[doc]
    p = np.exp(np.array([unknown.get(x, -25.0) for x in langs]))[doc]
    p += _less(found["one"][:, 0], shards.discounts[:, 0], lang) / shards.totals[lang]
    for order, gram, context in ((1, "two", "middle"), (2, "three", "context")):
        d, (total, *kinds) = shards.discounts[:, order], found[context].T
        freed = sum(d[lang, i] * n for i, n in enumerate(kinds, 1))
        p = np.where(total > 0, (_less(found[gram][:, 0], d, lang) + freed * p) / np.maximum(total, 1), p)
    return doc, np.log(p)


def _less(counts: np.ndarray, d: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """Counts less their discounts."""
    return counts - d[lang, np.minimum(counts, 3)]


def _judged(model: Model, parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    try:
        shards = _load(model.path)
        for text, lang in parts:
            # the more shards, the more text must be looked up together for each to be worth opening
            langs, at = lang.to_pylist(), cuts(text, AT_ONCE * min(8, max(1, len(shards.by_middle) // 16)))
            totals, counts = [np.zeros(0)], [np.zeros(0, np.int64)]
            for i, j in zip(at[:-1], at[1:]):
                doc, logp = log_probabilities(shards, model.unknown, text.slice(i, j - i), langs[i:j])
                totals.append(np.bincount(doc, logp, j - i).astype(np.float64))  # without any word bincount gives integers
                counts.append(np.bincount(doc, minlength=j - i))
            yield pa.StructArray.from_arrays([pa.array(-np.concatenate(totals)), pa.array(np.concatenate(counts))], ["nll", "n"])
    finally:
        give_back()


def scored(docs: DataFrame, model: Model) -> tuple[DataFrame, str]:
    """``docs`` with, under a free name, a struct of the sum of negative log probabilities and the number of words.

    Only text and language go to the workers, and only numbers come back.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf("nll double, n bigint")
    def judge(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return _judged(model, parts)

    name = free_name(docs, "_score")
    # said not to be deterministic so that filters on it don't compute it anew
    return docs.withColumn(name, judge.asNondeterministic()(plain(docs, "text", "string"), plain(docs, "lang", "string"))), name


def quality_model(docs: DataFrame, labels: DataFrame, rows: int | None = ROWS, quantile: float = QUANTILE) -> tuple[Model, dict[str, tuple[float, float]]]:
    """The model and, by language, the mean of trusted text's cross-entropy and the threshold of the averaged one."""
    sample = labelled_sample(docs, labels.where("quality = 1"), rows, by_language=True)
    third = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(3))
    model = train(sample.where(third > 0))
    rated, score = scored(sample.where(third == 0).select("text", "lang"), model)
    held, path = written(rated.where(F.col(score)["n"] > 0).select("lang", F.col(score)["nll"].alias("nll"), F.col(score)["n"].alias("n")), "held-out")
    bounds = limits(held, set(model.unknown), quantile)
    drop(docs.sparkSession, path)
    return model, bounds


def limits(held: DataFrame, known: set[str], quantile: float) -> dict[str, tuple[float, float]]:
    """By language: the mean and the ``quantile`` of ``held``(lang, nll, n), each averaged with PRIOR words of the mean.

    The quantile is exact, between two neighbours in order of score; only rows above it are ranked.
    """
    sums = held.groupBy("lang").agg(F.sum("nll").alias("nll"), F.sum("n").alias("n"), F.count("*").alias("rows")).where(F.col("rows") >= LEAST).collect()
    means = {r["lang"]: (r["nll"] / r["n"], r["rows"]) for r in sums if r["lang"] in known}
    if not means:
        return {}
    mean = F.create_map(*[F.lit(x) for lang, (m, _) in means.items() for x in (lang, m)])[F.col("lang")]
    score = ((F.col("nll") + PRIOR * mean) / (F.col("n") + PRIOR)).alias("score")
    at = {lang: quantile * (rows - 1) for lang, (_, rows) in means.items()}
    top = {lang: rows - int(at[lang]) for lang, (_, rows) in means.items()}  # the lower neighbour's place from above
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"))).alias("place")
    # a bound that all languages share lets each task leave out the rest before anything is exchanged
    ranked = held.where(F.col("lang").isin(list(means))).select("lang", score).select("lang", "score", place).where(F.col("place") <= max(top.values()))
    wanted = F.create_map(*[F.lit(x) for lang, n in top.items() for x in (lang, n)])[F.col("lang")]
    found = {(r["lang"], r["place"]): r["score"] for r in ranked.where(F.col("place").isin(wanted, wanted - 1)).collect()}
    out = {}
    for lang, (m, _) in means.items():
        low = found[lang, top[lang]]
        out[lang] = (m, low + (at[lang] - int(at[lang])) * (found.get((lang, top[lang] - 1), low) - low))
    return out


def quality_filter(docs: DataFrame, labels: DataFrame, score: str | None = None, **how) -> DataFrame:
    """The rows of ``docs`` that read like trusted text, in all their columns and, if named, their perplexity.

    A model of words (runs between white space, case kept) is trained on all documents that are labelled good, but for
    each third, by hash of doc_id, which it mustn't have seen: a row stays if its cross-entropy, averaged with PRIOR
    words of its language's mean, is at most the ``quantile`` of all of these. ``rows`` bounds the documents of each
    language that are used, if given. Texts without a word, null ones included, are rejected; very long ones are read to their end. Rows
    whose lang is null or has fewer than LEAST trusted documents held out can't be judged and stay. A null doc_id
    doesn't matter; repeated rows and ties are decided alike; further columns pass through whatever their names; an
    empty table gives an empty table. One pass over the texts without an exchange: workers map the model's shards.
    """
    model, bounds = quality_model(docs, labels, **how)
    rated, name = scored(docs, model)
    nll, n = F.col(name)["nll"], F.col(name)["n"]
    lang = plain(rated, "lang", "string")
    good = F.lit(True)
    for own, (mean, limit) in bounds.items():
        good = F.when(lang == own, (nll + PRIOR * mean) / (n + PRIOR) <= limit).otherwise(good)
    kept = rated.where((n > 0) & good)
    more = [F.exp(nll / n).alias(score)] if score else []
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns], *more)
