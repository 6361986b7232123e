"""Retrieval packing: a sharded BM25 index finds, for a seed document, unused neighbours to fill its window.

Documents are dealt to shards by what they are about, so that a seed's neighbours lie in its own shard
however many shards there are.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialise
from .common import map_rows, texts

WINDOW = 2048
END_ID = 1
SHARD_TOKENS = 500_000  # tokens of one shard's index, about: the unit of retrieval and of parallel work
THEME_WINDOWS = 8  # a theme's documents fill this many windows at least, about
K1, B = 1.2, 0.75
TERMS = np.random.Generator(np.random.PCG64(7)).permutation(1 << 16)  # one random order of all terms
ORDER = np.argsort(TERMS)
CACHE = 400_000  # words a worker remembers: about 200 bytes each
GROUP_CHARS = 1 << 22  # texts whose words are looked up together hold so many code points, about
BLANK = re.compile("[ \n]")

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# Byte-level vocabularies write each byte as a printable character: itself, or one from 256 on.
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_CHARACTERS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _strings(a: pa.Array) -> list[str]:
    return a.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Token ids of whole texts, from remembered ids of blank-separated words.

    The tokenizer drops white space and never joins across it, so a text's ids are its words' ids. It
    also takes letters apart from marks: a word of letters with ASCII marks after it, or none, goes to
    the vocabulary directly; every other word, and what normalising or lower-casing treats by its
    surroundings, through the tokenizer's own steps. Where a text spells an added token, that token's id
    stands there and the parts around it are encoded each for itself, as the tokenizer does.

    Arrow splits and numbers the words of many texts at once; Python sees each different word once a group.
    """

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: np.array([i], "<u2") for i, t in added.items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.spelt = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None
        self.cache = cache
        self.letters: dict[str, bytes] = {}  # by letters, A-Z lower-cased; empty where the whole word decides
        self.whole: dict[str, bytes] = {}

    def _letters(self, cores: list[str]) -> list[bytes]:
        known, tokenize = self.letters, self.tokenizer.model.tokenize
        out = list(map(known.get, cores))
        for k in [k for k, raw in enumerate(out) if raw is None]:
            core = cores[k]
            if not core.isalpha():
                raw = b""
            elif core.isascii():
                raw = array("H", [t.id for t in tokenize(core)]).tobytes()
            elif "\u03a3" in core or "\u0130" in core or not unicodedata.is_normalized("NFC", core):
                raw = b""
            else:
                shown = core.lower().encode().decode("latin-1").translate(BYTE_CHARACTERS)
                raw = array("H", [t.id for t in tokenize(shown)]).tobytes()
            known[core] = out[k] = raw
        return out

    def _whole(self, words: list[str]) -> list[bytes]:
        new = [w for w in dict.fromkeys(words) if w not in self.whole]
        for w, e in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False)):
            self.whole[w] = np.array(e.ids, "<u2").tobytes()
        return [self.whole[w] for w in words]

    def _words(self, words: pa.Array) -> list[bytes]:
        """Ids of different words."""
        if len(self.letters) + len(self.whole) > self.cache:
            self.letters.clear()
            self.whole.clear()
        cores = pc.ascii_rtrim(words, MARKS)
        marks = pc.subtract(pc.binary_length(words), pc.binary_length(cores)).to_numpy()
        cores = pc.ascii_lower(cores).dictionary_encode()
        ids, of = self._letters(_strings(cores.dictionary)), cores.indices.to_numpy()
        out = list(map(ids.__getitem__, of.tolist()))
        other = np.fromiter(map(len, ids), np.int64, len(ids))[of] == 0
        at = np.flatnonzero(other)
        for k, raw in zip(at.tolist(), self._whole(_strings(words.take(pa.array(at))))):
            out[k] = raw
        at = np.flatnonzero((marks > 0) & ~other)
        tails = [w[-n:] for w, n in zip(_strings(words.take(pa.array(at))), marks[at].tolist())]
        for k, raw in zip(at.tolist(), self._whole(tails)):
            out[k] += raw
        return out

    def _texts(self, texts: list[str]) -> list[np.ndarray]:
        lists = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        words = lists.flatten().dictionary_encode()
        ids = [*self._words(words.dictionary), np.uint16(END_ID).tobytes()]
        # The end id is one more word of each text.
        ends = lists.offsets.to_numpy()[1:]
        place = np.insert(words.indices.to_numpy(), ends, len(ids) - 1)
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        many = length[place]
        until = np.cumsum(many)
        at = np.repeat((np.cumsum(length) - length)[place] - (until - many), many)
        at += np.arange(len(at))
        ids = np.frombuffer(b"".join(ids), "<u2")[at]
        return np.split(ids, until[ends + np.arange(len(ends))][:-1])

    def __call__(self, batch: list[str]) -> list[np.ndarray]:
        """Ids of each text, the end id last; 16 bits hold the vocabulary's ids."""
        apart = [len(text) > GROUP_CHARS or any(map(text.__contains__, self.added)) for text in batch]
        together = iter(self._texts([text for text, alone in zip(batch, apart) if not alone]))
        return [self._parts(text) if alone else next(together) for text, alone in zip(batch, apart)]

    def _parts(self, text: str) -> np.ndarray:
        """Ids of a text that is long or spells an added token."""
        found = []
        for part in self.spelt.split(text) if self.spelt else [text]:
            if part in self.added:
                found.append(self.added[part])
                continue
            at = 0
            while len(part) - at > GROUP_CHARS and (blank := BLANK.search(part, at + GROUP_CHARS)):
                found.append(self._texts([part[at : blank.start()]])[0][:-1])
                at = blank.end()
            found.append(self._texts([part[at:]])[0][:-1])
        return np.concatenate([*found, np.array([END_ID], "<u2")])


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _groups(batches: Iterator[dict]) -> Iterator[tuple[list[int], list[str]]]:
    """Rows of batches, until their texts reach ``GROUP_CHARS`` code points; an empty one counts too."""
    doc_ids, group, held = [], [], 0
    for b in batches:
        for doc_id, text in zip(b["doc_id"], b["text"]):
            doc_ids.append(doc_id)
            group.append(text)
            held += len(text) + 100
            if held >= GROUP_CHARS:
                yield doc_ids, group
                doc_ids, group, held = [], [], 0
    if group:
        yield doc_ids, group


def tokenised(docs: DataFrame, path: str, cache: int = CACHE) -> DataFrame:
    """Full windows (checksum only), the rest of each document (its ids), and counts of documents by token.

    A row without a doc_id can be any of them: ``kind`` is w, r or c.
    """

    def rows(batches: Iterator[dict]):
        encode = Encoder(path, cache)
        having, last = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        for doc_ids, group in _groups(batches):
            for doc_id, ids in zip(doc_ids, encode(group)):
                n, whole = len(ids), len(ids) // WINDOW * WINDOW
                place = np.arange(n)
                last[ids] = place
                having[ids[last[ids] == place]] += 1  # each id once, where it stands last
                for at in range(0, whole, WINDOW):
                    yield "w", doc_id, at, WINDOW, n, _crc(ids[at : at + WINDOW]), None
                if n > whole:
                    yield "r", doc_id, whole, n - whole, n, None, ids[whole:].tobytes()
        seen = np.flatnonzero(having)
        yield "c", None, 0, 0, 0, None, np.stack([seen, having[seen]]).astype("<i8").tobytes()

    schema = "kind string, doc_id long, start long, length long, doc_tokens long, crc long, ids binary"
    return map_rows(texts(docs), rows, schema, 500)


def _document_counts(parts: DataFrame) -> np.ndarray:
    """Documents that hold each token id, over the whole table; as many numbers as the vocabulary has."""

    def rows(batches):
        for b in batches:
            for raw in b["ids"]:
                ids, n = np.frombuffer(raw, "<i8").reshape(2, -1)
                yield from zip(ids.tolist(), n.tolist())

    counts = map_rows(parts.filter("kind = 'c'").select("ids"), rows, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    got = counts.toArrow()
    out = np.zeros(1 << 16, np.int64)
    out[got["id"].to_numpy()] = got["n"].to_numpy()
    return out


def bm25(terms, tf, length, idf: np.ndarray, mean_length: float) -> np.ndarray:
    """Weight of a term that stands ``tf`` times in a unit of a length."""
    tf = tf.astype(np.float32)
    return idf[terms] * tf * np.float32(K1 + 1) / (tf + np.float32(K1) * (1 - B + B * length / np.float32(mean_length))).astype(np.float32)


def themes(units: list[np.ndarray], idf: np.ndarray, mean_length: float) -> tuple[np.ndarray, np.ndarray]:
    """Two telling terms of each unit; -1 where it has no second one.

    Telling are terms with at least half the greatest weight of the unit. Of them the first two in one random
    order of all terms are chosen, so the chance that two units agree is what their telling terms have in common.
    ``idf`` is 0 for terms that are not to be chosen unless there is no other.
    """
    sizes = np.array([len(u) for u in units])
    key, tf = np.unique(np.repeat(np.arange(len(units)), sizes) << 16 | np.concatenate(units), return_counts=True)
    owner, terms = key >> 16, key & 0xFFFF
    weight = bm25(terms, tf, sizes[owner].astype(np.float32), idf, mean_length)
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    telling = weight * 2 >= np.maximum.reduceat(weight, starts)[owner]
    order = np.where(telling, ORDER[terms], len(ORDER))
    out = []
    for _ in range(2):
        first = np.minimum.reduceat(order, starts)
        out.append(np.where(first < len(ORDER), TERMS[first % len(ORDER)], -1))
        order[order == first[owner]] = len(ORDER)
    return out[0], out[1]


class Index:
    """BM25 postings of a shard's units; terms that many units hold stand in a table instead."""

    def __init__(self, units: list[np.ndarray], idf: np.ndarray, mean_length: float):
        found = [np.unique(u, return_counts=True) for u in units]
        self.n = n = len(units)
        self.own = np.cumsum([0, *(len(t) for t, _ in found)])
        self.own_terms = terms = np.concatenate([t for t, _ in found])
        tf = np.concatenate([c for _, c in found])
        owner = np.repeat(np.arange(n), np.diff(self.own))
        length = np.array([len(u) for u in units], np.float32)[owner]
        weight = bm25(terms, tf, length, idf, mean_length)
        # The table has at most four places for each posting.
        common = np.flatnonzero(np.bincount(terms, minlength=1 << 16) * 4 > n)
        self.column = np.full(1 << 16, -1, np.int64)
        self.column[common] = np.arange(len(common))
        at = self.column[terms]
        self.table = np.zeros((n, len(common)), np.float32)
        self.table[owner[at >= 0], at[at >= 0]] = weight[at >= 0]
        rare = np.flatnonzero(at < 0)
        rare = rare[np.argsort(terms[rare], kind="stable")]
        self.owner, self.weight = owner[rare], weight[rare]
        self.bounds = np.searchsorted(terms[rare], np.arange((1 << 16) + 1))

    def scores(self, unit: int) -> np.ndarray:
        """BM25 of all units for all terms of the seed."""
        terms = self.own_terms[self.own[unit] : self.own[unit + 1]]
        at = self.column[terms]
        asked = np.zeros(self.table.shape[1], np.float32)
        asked[at[at >= 0]] = 1
        out = self.table @ asked
        rare = terms[at < 0].astype(np.int64)
        first = self.bounds[rare]
        many = self.bounds[rare + 1] - first
        if many.sum():
            postings = np.arange(many.sum()) + np.repeat(first - (np.cumsum(many) - many), many)
            out += np.bincount(self.owner[postings], self.weight[postings], self.n).astype(np.float32)
        return out


def pack_units(units: list[np.ndarray], index: Index) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of (unit, first token, length). Each token of each unit lies in one of them.

    A seed is the next unit with tokens left. Its neighbours follow by falling score, ties by number; the
    one that does not fit is cut, and its rest stays to be found again or to become a seed.
    """
    left = np.array([len(u) for u in units])
    used = np.zeros(len(units), np.int64)
    at = 0
    while True:
        while at < len(units) and left[at] == 0:
            at += 1
        if at == len(units):
            return
        window, room = [], WINDOW

        def take(u):
            n = int(min(left[u], room))
            window.append((int(u), int(used[u]), n))
            left[u] -= n
            used[u] += n
            return n

        room -= take(at)
        if room:
            scores = index.scores(at)
            scores[left == 0] = -1
            best = 32
            while room:
                # Enough of the best for the room, more if they turn out short.
                if best < index.n:
                    some = np.argpartition(-scores, best)[:best]
                    some = some[np.lexsort((some, -scores[some]))]
                else:
                    some = np.lexsort((np.arange(index.n), -scores))
                for u in some:
                    if scores[u] >= 0 and left[u] and room:
                        room -= take(u)
                        scores[u] = -1
                if best >= index.n:
                    break
                best *= 8
        yield window


def _themed(rests: DataFrame, idf: np.ndarray, mean_length: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                first, second = themes([np.frombuffer(x, "<u2") for x in batch["ids"].to_pylist()], idf, mean_length)
                columns = [*batch.columns, pa.array(first, pa.int64()), pa.array(second, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "theme", "second"])

    given = rests.select("doc_id", "start", "length", "doc_tokens", "ids", "row")
    return given.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, ids binary, row long, theme long, second long")


def dealt(themed: DataFrame, shard_tokens: int) -> DataFrame:
    """Units with ``bucket``, ``part``, ``salt``: together the name of their shard, of about ``shard_tokens``.

    Themes that fit a shard are put together whole, several to a shard. A larger theme is cut by the second
    term; units that share both terms and still exceed a shard are dealt by the hash of their row.
    The sizes are exact sums over all units. What is joined to the units are two small tables: of the large themes (never
    more than the vocabulary), and of pairs that exceed a shard (one for each shard's tokens at most). Both are written
    first, so Spark broadcasts one only if its size allows it.
    """
    tokens, most = F.col("tokens"), F.lit(shard_tokens)
    of_theme = Window.partitionBy("theme")
    sizes = themed.groupBy("theme", "second").agg(F.sum("length").alias("tokens"))
    sizes = sizes.withColumns({
        "whole": F.sum("tokens").over(of_theme),
        "light": F.sum(F.when(tokens <= most, tokens)).over(of_theme),
    })
    sizes = materialise(sizes, "sizes")
    fits = F.col("whole") <= most
    small = sizes.filter(fits).agg(F.sum("tokens")).first()[0] or 0
    large = materialise(sizes.filter(~fits).groupBy("theme").agg(F.max(F.coalesce("light", F.lit(0))).alias("light")), "large")
    heavy = materialise(sizes.filter(~fits & (tokens > most)).select("theme", "second", "tokens"), "heavy")

    def one_of(c: str, n) -> Column:
        return F.pmod(F.xxhash64(c), F.greatest(F.lit(1), F.ceil(n / most)).cast("long"))

    fits, light = F.col("light").isNull(), tokens.isNull()
    names = {
        "bucket": F.when(fits, F.lit(-1)).otherwise(F.col("theme")),
        "part": F.when(light, F.lit(-2)).otherwise(F.col("second")),
        "salt": F.when(fits, one_of("theme", F.lit(small))).when(light, one_of("second", F.col("light"))).otherwise(one_of("row", tokens)),
    }
    sized = themed.join(large, "theme", "left").join(heavy, ["theme", "second"], "left")
    return sized.withColumns(names).drop("theme", "second", "light", "tokens")


def pack(docs: DataFrame, tokenizer: str | None = None, cache: int = CACHE, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces of all documents, in sequences of at most 2048 tokens.

    A null text counts as empty and is one piece, the end id alone. Rows that share a doc_id are packed
    each for itself. Windows that a document fills alone are sequences of their own; what is left of
    it is a seed or a neighbour. Every sequence is full except the last of each shard. An empty table gives no pieces.

    A shard holds documents that share telling terms (:func:`themes`, :func:`dealt`), about ``shard_tokens`` tokens
    of them; telling are terms of great BM25 weight that stand in enough documents to fill some windows.
    Statistics of terms come from all documents. What windows hold does not depend on how files
    are split, unless more than a shard of documents share both terms; ``sequence_id`` does.
    """
    path = tokenizer or default_tokenizer()
    parts = tokenised(docs, path, cache).withColumn("row", F.monotonically_increasing_id())
    parts = materialise(parts, "tokens")
    rest = parts.filter("kind = 'r'").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("tokens")).first()
    having = _document_counts(parts)
    # Every document has the end id exactly where its text ends.
    documents = int(having[END_ID])
    idf = np.log1p((documents - having + 0.5) / (having + 0.5)).clip(0).astype(np.float32)
    mean_length = max(1.0, (rest["tokens"] or 0) / max(1, rest["n"]))
    telling = np.where(having * mean_length >= THEME_WINDOWS * WINDOW, idf, 0).astype(np.float32)
    themed = materialise(_themed(parts.filter("kind = 'r'"), telling, mean_length), "themes")

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def shard(group: pa.Table) -> pa.Table:
        g = group.sort_by([(c, "ascending") for c in ("doc_id", "start", "doc_tokens", "ids", "row")]).to_pydict()
        units = [np.frombuffer(x, "<u2") for x in g["ids"]]
        out = []
        for window in pack_units(units, Index(units, idf, mean_length)):
            # A seed is used up by its window, so its row names the sequence.
            offset, sequence = 0, g["row"][window[0][0]]
            for u, first, n in window:
                crc = _crc(units[u][first : first + n])
                out.append((g["doc_id"][u], g["start"][u] + first, n, crc, g["doc_tokens"][u], sequence, offset))
                offset += n
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    packed = dealt(themed, shard_tokens).groupBy("bucket", "part", "salt").applyInArrow(shard, PIECE)
    full = parts.filter("kind = 'w'").select(
        "doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return full.unionByName(packed)
