"""Quality classifier: an interpolated modified Kneser-Ney trigram model of trusted text.

Every word of trusted text is in the vocabulary of its language; only words that trusted text never
has are unknown, and share what the discounts leave at the lowest order. All n-grams are kept. N-grams
go by 64-bit hashes of their words; among a thousand million of them two meet with a chance of 3 %.

The model is a table of packed blocks (``qamill.llm.packed``), bucketed by shard: sorted keys with
counts, continuation counts, and totals of contexts. A pair lies in the shard of its key, a trigram
in that of its context. Trusted text is read twice, its trigrams dealt once by their context and once
by the pair they end in, so each time one shard has all it must count together. Nothing of the model
but discounts by language reaches the driver.

Documents are scored in slices of chunks. A chunk sends each shard a block of the different keys it
needs, gets the counts back in the same order, and adds up the costs of its texts. What a slice
shuffles is gone when its costs are written, and the buckets of the model are read where they lie, so
the disk that is taken is the model's and a slice's.

A document's score is the mean cost of its words, drawn a little towards the trusted mean of its
language so that a few words prove nothing. It is kept up to a quantile of the scores of the
trusted documents of its language that were not trained on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qamill.llm.common import WORD, few
from qamill.llm.packed import grouped, pack, sorted_by, unpack
from qamill.session import BucketTable, materialise, releasing

PRIOR = 25.0          # words at the trusted mean that every document is given
QUANTILE = 0.99       # of the trusted scores of a language that is kept
KEPT_BACK = 5         # one in so many trusted documents sets the levels and is not trained on
SMALL_SIDE = 4 << 20  # rows of labels up to which they are broadcast (16 bytes each)
CHUNK = 4_000_000     # characters of text whose n-grams are looked up together
ROUNDS = 2            # parts of the shards that are counted one after the other
SLICES = 16           # parts of the chunks, at most, that are scored one after the other
AT_ONCE = 12          # chunks, at least, that are scored together
WORD_SHARDS = 4       # shards whose words are added up together

MOST_LANGS = 10_000   # language labels; more of them are an error in the table

EDGE = 0              # before the first and after the last word
SHAPES = 0            # classes of words outside the vocabulary: none are needed

# kinds of rows of the model: n-grams by their order (blocks of keys, n, t, x1, x2, x3; trigrams have keys and
# n only), parts that are dropped when added up, and counts of counts by order
WORDS, PAIRS, TRIGRAMS, CONTEXTS, WORD_PARTS, COUNTS = 1, 2, 3, 4, 5, 10
ROWS = "shard int, lang long, block binary, counts array<long>, kind int"


def words(text: str | None) -> list[bytes]:
    """Split at ASCII white space."""
    return text.encode().split() if text else []


def _numbers(distinct: list[bytes] | np.ndarray) -> np.ndarray:
    return hash_array(np.array(distinct, dtype=object), categorize=False).view(np.int64)


def number(word: bytes) -> int:
    return int(_numbers([word])[0])


class Codes(dict):
    """Number of every word."""

    def __init__(self, vocabulary: dict[str, int] | None = None):
        super().__init__({w.encode(): n for w, n in (vocabulary or {}).items()})

    def __missing__(self, word: bytes) -> int:
        return number(word)

    def of(self, found: pa.Array) -> np.ndarray:
        """Numbers of many words."""
        coded = found.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)
        numbers = _numbers(distinct) if len(distinct) else np.zeros(0, dtype=np.int64)
        if self:
            numbers = np.array([self.get(w.encode(), n) for w, n in zip(distinct, numbers.tolist())], dtype=np.int64)
        return numbers[coded.indices.to_numpy(zero_copy_only=False)]


def _codes(text: str | None, codes: Codes) -> np.ndarray:
    """Numbers of the words of a text after two edges and before one."""
    return np.array([EDGE, EDGE, *[codes[w] for w in words(text)], EDGE], dtype=np.int64)


_P = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                             0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _hashed(values: np.ndarray, seeds) -> np.ndarray:
    """What Spark's xxhash64 makes of longs after columns that gave ``seeds``."""
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    x = np.atleast_1d(values).astype(np.int64).view(np.uint64)
    h = np.atleast_1d(np.asarray(seeds)).astype(np.int64).view(np.uint64) + _P[4] + np.uint64(8)
    h = turn(h ^ (turn(x * _P[1], 31) * _P[0]), 27) * _P[0] + _P[3]
    h = (h ^ (h >> np.uint64(33))) * _P[1]
    h = (h ^ (h >> np.uint64(29))) * _P[2]
    return (h ^ (h >> np.uint64(32))).view(np.int64)


class Facts(NamedTuple):
    """Of a language: the total of the lowest order, what its discounts leave per word, discounts by order and count."""

    total: float
    rest: float
    cuts: np.ndarray


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every unsigned key; it grows with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


class Asked(NamedTuple):
    """Different keys of an order, shard by shard and sorted in a shard."""

    keys: np.ndarray
    starts: np.ndarray  # where each shard starts, and the end
    first: np.ndarray   # a position where each key is
    place: np.ndarray   # of every position: where its key is among the keys


class Grams:
    """The n-grams of many texts: keys of orders 1 to 3 at every position, and where a trigram ends."""

    def __init__(self, langs: list[str], texts: list[str | None], codes: Codes):
        split = pc.ascii_split_whitespace(pc.fill_null(pa.array(texts, pa.string()), ""))
        found, of = split.flatten(), pc.list_parent_indices(split).to_numpy()
        full = pc.not_equal(found, "")  # white space at an end leaves an empty word there
        self.words = np.bincount(of[full.to_numpy(zero_copy_only=False)], minlength=len(split))
        sizes = self.words + 3
        self.row = np.repeat(np.arange(len(split)), sizes)
        first = np.cumsum(sizes) - sizes
        inner = np.ones(len(self.row), dtype=bool)
        inner[first] = inner[first + 1] = inner[first + sizes - 1] = False
        self.codes = np.full(len(self.row), EDGE, dtype=np.int64)
        self.codes[inner] = codes.of(found.filter(full))
        numbers = {lang: number(lang.encode()) for lang in set(langs)}
        self.langs = np.array([numbers[lang] for lang in langs], dtype=np.int64)
        self.lang = self.langs[self.row]
        inner[first + sizes - 1] = True
        self.ends = np.flatnonzero(inner)
        inner[first + 1] = True
        self.after = np.flatnonzero(inner)  # positions that the costs ask words and pairs of
        # a key that reaches over the start of a text is made but never asked for
        self.one = _hashed(self.codes, _hashed(self.langs, 42)[self.row])
        self.two = _hashed(self.codes, np.roll(self.one, 1))
        self.three = _hashed(self.codes, np.roll(self.two, 1))

    def wanted(self) -> np.ndarray:
        """Different keys of all orders that the costs depend on."""
        return np.concatenate([a.keys for a in self.asked(1)]).view(np.int64)

    def asked(self, shards: int) -> list[Asked]:
        """What the costs ask of orders 1 to 3."""
        out = []
        for order, at in ((1, self.after), (2, self.after), (3, self.ends)):
            keys = (self.one, self.two, self.three)[order - 1][at].view(np.uint64)
            ranked, new = sorted_by(keys)
            first, place = at[ranked[new]], np.empty(len(self.codes), dtype=np.int64)
            keys = keys[ranked[new]]
            place[at[ranked]] = np.cumsum(new) - 1
            home = shard_of(keys if order < 3 else self.two[first - 1].view(np.uint64), shards)
            if order == 3:
                ranked = np.argsort(home.astype(np.int32), kind="stable")
                back = np.empty_like(ranked)
                back[ranked] = np.arange(len(ranked))
                keys, first, home, place[at] = keys[ranked], first[ranked], home[ranked], back[place[at]]
            out.append(Asked(keys, np.searchsorted(home, np.arange(shards + 1)), first, place))
        return out

    def costs(self, asked: list[Asked], known: list[list[np.ndarray]], facts: dict[int, Facts]) -> np.ndarray:
        """Sum of -log p per text, from (n, t, x1, x2, x3) of what is asked; NaN without a model.

        The discounted count of an n-gram, the total of a context and its weight for the lower order
        are rounded to 32 bits.
        """
        at = self.ends
        langs, which = np.unique(self.langs, return_inverse=True)
        none = Facts(np.nan, np.nan, np.full((3, 4), np.nan))
        facts_of = [facts.get(int(x), none) for x in langs]
        cuts = np.array([f.cuts for f in facts_of]).reshape(-1, 3, 4)
        narrow = lambda x: x.astype(np.float32).astype(np.float64)

        def cut(order):
            n, own = known[order - 1][0], which[self.row[asked[order - 1].first]]
            return narrow(n - cuts[own, order - 1, np.minimum(n, 3)])[asked[order - 1].place[at]]

        def lower(order, p):
            context = asked[order - 2]
            _, t, *x = known[order - 2]
            d = cuts[which[self.row[context.first]], order - 1]
            total = np.where(t > 0, t, 1)
            weight = narrow((x[0] * d[:, 1] + x[1] * d[:, 2] + x[2] * d[:, 3]) / total)
            place = context.place[at - 1]
            return np.where((t > 0)[place], cut(order) / narrow(total)[place] + weight[place] * p, p)

        total, rest = (np.array([f[i] for f in facts_of])[which][self.row[at]] for i in (0, 1))
        p = lower(3, lower(2, cut(1) / total + rest))
        return np.bincount(self.row[at], -np.log(p), len(self.words))


# What is broadcast by language has one row per language label.


def language(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def _trusted(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is in ``trusted_ids``; a small list of ids goes to the texts."""
    ids = trusted_ids.select("doc_id").where("doc_id IS NOT NULL").distinct()
    if ids.count() <= SMALL_SIDE:
        ids = F.broadcast(ids)
    return docs.join(ids, "doc_id", "left_semi")


def _trigram_blocks(trusted: DataFrame, shards: int, by_end: bool, turn: int, rounds: int) -> DataFrame:
    """(shard, lang, block): the different trigrams of many texts of a language and their counts, in every task.

    The shard is that of the context or, ``by_end``, of the pair that a trigram ends in. A block has the
    words it is about and the places of the three words among them. Of ``rounds`` turns each has other shards.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, langs, texts, size = Codes(), [], [], 0

        def out() -> pa.RecordBatch:
            grams = Grams(langs, texts, codes)
            at = grams.ends
            home = shard_of(grams.two[at if by_end else at - 1].view(np.uint64), shards)
            at, home = at[home % rounds == turn], home[home % rounds == turn]
            ranked, new = sorted_by(grams.three[at])
            n = np.diff(np.flatnonzero(new), append=len(at))
            at, home = at[ranked[new]], home[ranked[new]]
            distinct, ids = np.unique(grams.codes.view(np.uint64), return_inverse=True)
            block = np.unique(grams.langs, return_inverse=True)[1][grams.row[at]] * shards + home
            order = np.lexsort((ids[at - 1], ids[at - 2], block))
            at, n, home, block = at[order], n[order], home[order], block[order]
            cuts = np.flatnonzero(np.diff(block, prepend=-1))
            blocks = []
            for x, y in zip(cuts, [*cuts[1:], len(at)]):
                words_, places = np.unique(np.concatenate([ids[at[x:y] - i] for i in (2, 1, 0)]), return_inverse=True)
                a, b, c = places.reshape(3, -1)
                blocks.append(pack(distinct[words_], np.diff(a, prepend=0), b, c, n[x:y]))
            return pa.RecordBatch.from_arrays(
                [pa.array(home[cuts], pa.int32()), pa.array(grams.lang[at[cuts]], pa.int64()), pa.array(blocks, pa.binary())],
                names=["shard", "lang", "block"])

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                langs.append(lang)
                texts.append(text)
                size += len(text)
                if size > 2 * CHUNK:
                    yield out()
                    langs, texts, size = [], [], 0
        if langs:
            yield out()

    return trusted.select("lang", "text").mapInArrow(count, "shard int, lang long, block binary")


def _trigrams(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the blocks of a shard: languages, words (a, b, c) and counts, not yet added up."""
    langs, codes, counts = [], [], []
    for lang, block in zip(rows["lang"].to_pylist(), rows["block"].to_pylist()):
        words_, a, b, c, n = unpack(block)
        codes.append(words_[np.stack([np.cumsum(a), b, c])].view(np.int64))
        langs.append(np.full(len(n), lang, dtype=np.int64))
        counts.append(n)
    return np.concatenate(langs), np.concatenate(codes, axis=1), np.concatenate(counts)


def _as_context(n: np.ndarray) -> list[np.ndarray]:
    """Total and numbers of n-grams by count, of the contexts of n-grams found ``n`` times."""
    return [n, *[x.astype(np.int64) for x in (n == 1, n == 2, n > 2)]]


def _rows(found: list[tuple]) -> pa.Table:
    """Rows (shard, lang, block, counts, kind) of the model."""
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32())
    return pa.table([pa.array([r[i] for r in found], kind) for i, kind in enumerate(kinds)],
                    names=["shard", "lang", "block", "counts", "kind"])


def _counts(shard: int, order: int, lang: np.ndarray, n: np.ndarray) -> list[tuple]:
    """Of every language how many n-grams were found 1, 2, 3 and 4 times, how many at all, and the sum."""
    out = []
    for x in np.unique(lang[n > 0]):
        own = n[(lang == x) & (n > 0)]
        out.append((shard, int(x), None, [*[int((own == k).sum()) for k in (1, 2, 3, 4)], len(own), int(own.sum())],
                    COUNTS + order))
    return out


def _count_trigrams(rows: pa.Table) -> pa.Table:
    """A shard that has all trigrams of its contexts: trigrams, contexts, counts of counts."""
    shard = rows["shard"][0].as_py()
    lang, (a, b, c), n = _trigrams(rows)
    pair = _hashed(b, _hashed(a, _hashed(lang, 42)))
    keys, first, (n,) = grouped(_hashed(c, pair).view(np.uint64), n)
    contexts, _, sums = grouped(pair[first].view(np.uint64), *_as_context(n))
    return _rows([(shard, None, pack(keys, n), None, TRIGRAMS), (shard, None, pack(contexts, *sums), None, CONTEXTS),
                  *_counts(shard, 3, lang[first], n)])


def _count_pairs(shards: int, rows: pa.Table, contexts: pa.Table) -> pa.Table:
    """A shard that has all trigrams that end in its pairs, and its contexts: pairs, counts of counts, parts of words."""
    found, keys, table = [], np.zeros(0, dtype=np.uint64), np.zeros((5, 0), dtype=np.int64)
    shard = (rows if rows.num_rows else contexts)["shard"][0].as_py()
    if rows.num_rows:
        lang, (a, b, c), _ = _trigrams(rows)
        base = _hashed(lang, 42)
        _, first, _ = grouped(_hashed(c, _hashed(b, _hashed(a, base))))  # a trigram counts once
        b, c, lang, base = b[first], c[first], lang[first], base[first]
        one = _hashed(b, base)
        keys, first, (n,) = grouped(_hashed(c, one).view(np.uint64), np.ones(len(first), dtype=np.int64))
        lang = lang[first]
        found += _counts(shard, 2, lang, n)
        zero, ones = np.zeros(len(n), dtype=np.int64), np.ones(len(n), dtype=np.int64)
        parts = zip((zero, *_as_context(n)), (ones, zero, zero, zero, zero))
        words_, at, sums = grouped(np.concatenate([one[first], _hashed(c[first], base[first])]).view(np.uint64),
                                   *[np.concatenate(p) for p in parts])
        lang = np.concatenate([lang, lang])[at]
        home = shard_of(words_, shards) // WORD_SHARDS * WORD_SHARDS
        cuts = np.flatnonzero(np.diff(home, prepend=-1))
        for x, y in zip(cuts, [*cuts[1:], len(home)]):
            langs, place = np.unique(lang[x:y].view(np.uint64), return_inverse=True)
            found.append((int(home[x]), None, pack(words_[x:y], *[s[x:y] for s in sums], langs, place), None, WORD_PARTS))
        table = np.stack([n, zero, zero, zero, zero])
    if contexts.num_rows:
        more, *sums = unpack(contexts["block"][0].as_py())
        keys = np.concatenate([keys, more])
        keys, _, sums = grouped(keys, *np.concatenate([table, [np.zeros(len(more), dtype=np.int64), *sums]], axis=1))
        table = np.stack(sums)
    return _rows([*found, (shard, None, pack(keys, *table), None, PAIRS)])


def _count_words(shards: int, rows: pa.Table) -> pa.Table:
    """The parts of words of a few shards: words, counts of counts."""
    found, langs = [], []
    for block in rows["block"].to_pylist():
        *part, names, place = unpack(block)
        found.append(part)
        langs.append(names.view(np.int64)[place])
    keys, *sums = (np.concatenate(p) for p in zip(*found))
    keys, first, sums = grouped(keys, *sums)
    home = shard_of(keys, shards)
    cuts = np.flatnonzero(np.diff(home, prepend=-1))
    return _rows([*_counts(rows["shard"][0].as_py(), 1, np.concatenate(langs)[first], sums[0]),
                  *[(int(home[x]), None, pack(keys[x:y], *[s[x:y] for s in sums]), None, WORDS)
                    for x, y in zip(cuts, [*cuts[1:], len(home)])]])


def _discounts(counts: list[int]) -> list[float]:
    """Discounts of an n-gram not found, found once, twice and more often, from the counts of counts 1 to 4.

    Where these are too few to tell, one half.
    """
    n1, n2, n3, _ = counts
    if not (n1 and n2 and n3):
        return [0.0, 0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    return [0.0, *[max(0.1, min(float(k), k - (k + 1) * y * counts[k] / counts[k - 1])) for k in (1, 2, 3)]]


def _facts(model: BucketTable) -> dict[int, Facts]:
    sums = [F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(6)]
    rows = few(model.read().where(f"kind > {COUNTS}").groupBy("lang", "kind").agg(*sums), 3 * MOST_LANGS)
    found = {(r["lang"], r["kind"] - COUNTS): [r[f"c{i}"] for i in range(6)] for r in rows}
    out = {}
    for lang in {lang for lang, _ in found}:
        cuts = np.array([_discounts(found[lang, order][:4]) for order in (1, 2, 3)])
        one, two, _, _, types, total = found[lang, 1]
        held = one * cuts[0, 1] + two * cuts[0, 2] + (types - one - two) * cuts[0, 3]
        out[lang] = Facts(float(total), held / total / (types + 1), cuts)
    return out


def _block(rows: pa.Table, kind: int, width: int) -> list[np.ndarray]:
    """Sorted keys of a kind in the rows of a shard, and ``width`` columns for them."""
    for found, block in zip(rows["kind"].to_pylist(), rows["block"].to_pylist()):
        if found == kind:
            return unpack(block)
    return [np.zeros(0, dtype=np.uint64), *[np.zeros(0, dtype=np.int64)] * width]


def _found(wanted: np.ndarray, keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Values of sorted ``keys`` for those wanted; 0 where there are none."""
    if not len(keys):
        return [np.zeros(len(wanted), dtype=np.int64) for _ in values]
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    same = keys[place] == wanted
    return [np.where(same, v[place], 0) for v in values]


class Model:
    """Bucketed blocks of n-grams with their counts, and facts of every language."""

    rare: dict[str, float] = {}

    def __init__(self, blocks: BucketTable, facts: dict[int, Facts], trusted: DataFrame):
        self.blocks, self.facts, self.trusted = blocks, facts, trusted
        self._local = None

    @property
    def grams(self) -> DataFrame:
        """The blocks of n-grams."""
        return self.blocks.read().where(F.col("kind").isin(WORDS, PAIRS, TRIGRAMS)).select("shard", "kind", "block")

    @property
    def table(self) -> DataFrame:
        """Every n-gram: key, n, and as a context total and numbers of n-grams found once, twice and more often."""
        names = ["key", "n", "t", "x1", "x2", "x3"]

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in batch["block"].to_pylist():
                    keys, *found = unpack(block)
                    found += [np.zeros(len(keys), dtype=np.int64)] * (5 - len(found))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (keys.view(np.int64), *found)], names=names)

        return self.grams.select("block").mapInArrow(rows, ", ".join(f"{c} long" for c in names))

    @property
    def vocabulary(self) -> dict[str, dict[str, int]]:
        """Words by language with their numbers, read to the driver: for small models only."""
        out: dict[str, dict[str, int]] = {}
        for row in self.trusted.select("lang", "text").toLocalIterator():
            out.setdefault(row["lang"], {}).update((w.decode(), number(w)) for w in words(row["text"]))
        return out

    def cost(self, lang: str, text: str | None) -> tuple[float, int] | None:
        """(sum of -log p, words) of a text by a model read to the driver: for small models only."""
        grams = Grams([lang], [text], Codes())
        if int(grams.lang[0]) not in self.facts:
            return None
        if self._local is None:
            found = self.table.toArrow()
            keys = found["key"].to_numpy().view(np.uint64)
            order = np.argsort(keys)
            self._local = [keys[order], *[found[c].to_numpy()[order] for c in found.column_names[1:]]]
        asked = grams.asked(1)
        return float(grams.costs(asked, [_found(a.keys, *self._local) for a in asked], self.facts)[0]), int(grams.words[0])

    def drop(self) -> None:
        self.blocks.drop()


def train(trusted: DataFrame) -> Model:
    """A model of trusted (lang, text) rows; languages are never mixed."""
    spark = trusted.sparkSession
    total = trusted.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1 + total // CHUNK, int(spark.conf.get("spark.sql.shuffle.partitions")))
    model = BucketTable(spark, "ngrams", "shard", shards, "kind")
    blocks = lambda by_end, turn: _trigram_blocks(trusted, shards, by_end, turn, ROUNDS).groupBy("shard")
    # the functions that go to the tasks must not hold the session
    pairs, words_ = (lambda rows, contexts: _count_pairs(shards, rows, contexts)), (lambda rows: _count_words(shards, rows))
    with releasing(spark):
        for turn in range(ROUNDS):
            model.add(blocks(False, turn).applyInArrow(_count_trigrams, ROWS))
        for turn in range(ROUNDS):
            contexts = model.read().where((F.col("kind") == CONTEXTS) & (F.col("shard") % ROUNDS == turn)).groupBy("shard")
            model.add(blocks(True, turn).cogroup(contexts).applyInArrow(pairs, ROWS))
        model.remove(CONTEXTS)
        model.add(model.read().where(f"kind = {WORD_PARTS}").groupBy("shard").applyInArrow(words_, ROWS))
        model.remove(WORD_PARTS)
        return Model(model, _facts(model), trusted)


def _ask(shards: int, rows: pa.Table) -> pa.Table:
    """A chunk: for every shard the keys it is asked for."""
    asked = _grams_of(rows)[0].asked(shards)
    found = [(shard, pack(*[a.keys[a.starts[shard]:a.starts[shard + 1]] for a in asked])) for shard in range(shards)
             if any(a.starts[shard] < a.starts[shard + 1] for a in asked)]
    return pa.table({"chunk": pa.array(np.full(len(found), rows["chunk"][0].as_py()), pa.int64()),
                     "shard": pa.array([s for s, _ in found], pa.int32()), "block": pa.array([b for _, b in found], pa.binary())})


def _answer(rows: pa.Table, model: pa.Table) -> pa.Table:
    """A shard: the counts of the keys it is asked for, in their order; nothing where it has none of them."""
    known = [_block(model, WORDS, 5), _block(model, PAIRS, 5), _block(model, TRIGRAMS, 1)]
    found = [pack(*[v for wanted, own in zip(unpack(block), known) for v in _found(wanted, *own)])
             for block in rows["block"].to_pylist()]
    return pa.table({"chunk": rows["chunk"], "shard": rows["shard"], "block": pa.array(found, pa.binary())})


def _grams_of(rows: pa.Table) -> tuple[Grams, np.ndarray]:
    """The n-grams of the different texts of a chunk, and where these are."""
    _, first = np.unique(rows["key"].to_numpy(), return_index=True)
    some = rows.take(pa.array(first))
    return Grams(some["lang"].to_pylist(), some["text"].to_pylist(), Codes()), first


def _add_up(shards: int, facts: dict[int, Facts], rows: pa.Table, found: pa.Table) -> pa.Table:
    """A chunk: costs of its different texts from the answers."""
    if not rows.num_rows:
        return pa.table({"key": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "cost": pa.array([], pa.float64())})
    grams, first = _grams_of(rows)
    asked = grams.asked(shards)
    known = [[np.zeros(len(a.keys), dtype=np.int64) for _ in range(width)] for a, width in zip(asked, (5, 5, 1))]
    for shard, block in zip(found["shard"].to_pylist(), found["block"].to_pylist()):
        columns = iter(unpack(block))
        for a, values in zip(asked, known):
            for v in values:
                v[a.starts[shard]:a.starts[shard + 1]] = next(columns)
    cost = grams.costs(asked, known, facts)
    return pa.table({"key": rows["key"].take(pa.array(first)), "n": pa.array(grams.words, pa.int64()),
                     "cost": pa.array(cost, pa.float64(), mask=np.isnan(cost))})


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _key(text: str) -> Column:
    """What texts of a language go by; null is the empty text."""
    return F.xxhash64("lang", _text(text))


def _text_costs(texts: DataFrame, model: Model) -> DataFrame:
    """(key, n, cost) of the different ``texts`` (key, lang, text, draw), written.

    ``cost`` is null for a language without trusted text. Chunks are drawn by ``draw``, the hash of id and text,
    so equal texts under different ids are spread; only rows that repeat both meet in one chunk.
    """
    spark, shards, facts = texts.sparkSession, model.blocks.buckets, model.facts
    chunks = 1 + (texts.agg(F.sum(F.length("text"))).first()[0] or 0) // CHUNK
    slices = max(1, min(SLICES, chunks // AT_ONCE))
    tasks = max(chunks // slices, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = texts.select(F.pmod("draw", F.lit(chunks)).alias("chunk"), "key", "lang", "text")
    ask = lambda rows: _ask(shards, rows)
    add_up = lambda rows, found: _add_up(shards, facts, rows, found)
    out = []
    with releasing(spark):
        for i in range(slices):
            dealt = rows.where(F.col("chunk") % slices == i).repartition(tasks, "chunk")
            asked = dealt.groupBy("chunk").applyInArrow(ask, "chunk long, shard int, block binary")
            found = asked.groupBy("shard").cogroup(model.grams.groupBy("shard")).applyInArrow(
                _answer, "chunk long, shard int, block binary")
            out.append(materialise(dealt.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(
                add_up, "key long, n long, cost double"), "costs"))
        return materialise(reduce(DataFrame.unionByName, out).groupBy("key").agg(
            F.min("n").alias("n"), F.min("cost").alias("cost")), "text-costs")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (``doc``, a struct with ``text``, and ``lang``) plus ``n`` words and their ``cost``.

    ``cost`` is null for a language without trusted text.
    """
    costs = _text_costs(docs.select(_key("doc.text").alias("key"), "lang", _text("doc.text").alias("text"),
                                    _draw("doc.doc_id", "doc.text")), model)
    name = "_text_key"
    return docs.withColumn(name, _key("doc.text")).join(costs.withColumnRenamed("key", name), name, "left").select(
        *docs.columns, "n", "cost")


def _draw(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id).cast("string"), F.col(text).cast("string")).alias("draw")


def _by_lang(values: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for lang, value in values.items():
        out = F.when(F.col("lang") == lang, F.lit(value)).otherwise(out)
    return out


def _drawn(mean: Column) -> Column:
    return (F.col("cost") + PRIOR * mean) / (F.col("n") + PRIOR)


def _decide(docs: DataFrame, trusted_ids: DataFrame, quantile: float, columns: list[str]) -> DataFrame:
    """(doc, lang, n, score, level, keep); ``doc`` is the struct of ``columns`` of the row."""
    some = lambda text: F.coalesce(F.col(text).cast("string").rlike(WORD), F.lit(False))
    plain = docs.select(F.struct(*columns).alias("doc"), "doc_id", language(F.col("lang")).alias("lang"),
                        F.col("text").cast("string").alias("text"))
    rows = plain.select("doc", "lang", _key("text").alias("key"), some("text").alias("spoken"))
    trusted = _trusted(plain.drop("doc"), trusted_ids).where(some("text"))
    # scores of texts that the model has seen are too low; levels come from those kept back
    back = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(9)), F.lit(KEPT_BACK)) == 0
    model = train(trusted.where(~back))
    found = _text_costs(plain.select(_key("text").alias("key"), "lang", _text("text").alias("text"),
                                     _draw("doc_id", "text")), model)
    model.drop()
    held = trusted.where(back).select(_key("text").alias("key"), "lang").join(found, "key")
    costs = materialise(held.where("cost IS NOT NULL").select("lang", "n", "cost"), "trusted-costs")
    mean = _by_lang({r["lang"]: r["m"] for r in few(costs.groupBy("lang").agg(
        (F.sum("cost") / F.sum("n")).alias("m")), MOST_LANGS)})
    level = _by_lang({r["lang"]: r["q"] for r in few(costs.groupBy("lang").agg(
        F.percentile_approx(_drawn(mean), quantile, 10000).alias("q")), MOST_LANGS)})
    scored = rows.join(found, "key", "left").withColumn("score", _drawn(mean))
    keep = F.col("spoken") & F.coalesce(F.col("score") <= level, F.lit(True))
    return scored.select("doc", "lang", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "score",
                         level.alias("level"), keep.alias("keep"))


def judge(docs: DataFrame, trusted_ids: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_words, perplexity, threshold, keep for every row of ``docs``.

    ``trusted_ids`` (doc_id) names the trusted documents. Perplexity is e to the score. A null
    text or one without words is rejected. A null language is one of its own; documents of a
    language without trusted text have no perplexity and are kept. Equal rows get equal results;
    other columns are ignored.
    """
    return _decide(docs.select("doc_id", "lang", "text"), trusted_ids, quantile, ["doc_id"]).select(
        F.col("doc.doc_id").alias("doc_id"), "lang", F.col("n").alias("n_words"),
        F.exp("score").alias("perplexity"), F.exp("level").alias("threshold"), "keep")


def keep_good(docs: DataFrame, trusted_ids: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The documents that are kept, with all their columns."""
    return _decide(docs, trusted_ids, quantile, docs.columns).where("keep").select("doc.*")
