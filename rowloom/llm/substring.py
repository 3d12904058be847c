"""Substring dedup: recurring passages found by sharded phrase automata."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type as _arrow

from rowloom.llm.common import col, cut
from rowloom.llm.prefix import with_prefix

WINDOW = 20
SHINGLE = 5
#: Bytes of text that one shard of documents holds on average.
SHARD_BYTES = 4_000_000
#: Bytes of text for which there is an automaton. Were all of it recurring, an automaton would be streamed some 2,500
#: stretches of 27 words.
DEAL_BYTES = 150_000
#: Places of one phrase that are streamed through one automaton.
DEAL_ROWS = 1_000
#: Words that are hashed at a time.
CHUNK_WORDS = 200_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _chained(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of h[i : i + n] for each i, by doubling (values past the end are meaningless)."""
    parts, size, block = [], 1, h
    out, done = None, 0
    while n:
        if n & 1:
            if out is None:
                out, done = block, size
            else:
                out = out * np.uint64(pow(int(_MIX), size, 1 << 64)) + _ahead(block, done)
                done += size
        n >>= 1
        if n:
            block = block * np.uint64(pow(int(_MIX), size, 1 << 64)) + _ahead(block, size)
            size *= 2
    return out


def _ahead(a: np.ndarray, n: int, fill: int = 0) -> np.ndarray:
    """a[i + n] at i."""
    out = np.full_like(a, fill)
    if n < len(a):
        out[: len(a) - n] = a[n:]
    return out


def _behind(a: np.ndarray, n: int) -> np.ndarray:
    """a[i - n] at i, 0 before."""
    out = np.zeros_like(a)
    if n < len(a):
        out[n:] = a[: len(a) - n]
    return out


def _sliding(a: np.ndarray, n: int, join, shift) -> np.ndarray:
    """join over n places, by doubling; joining a place twice does no harm."""
    done, out = 1, a
    while done < n:
        step = min(done, n - done)
        out = join(out, shift(out, step))
        done += step
    return out


def _scramble(h: np.ndarray) -> np.ndarray:
    """Bijective mixing, so that the smallest hash doesn't favour any word."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Words:
    """The words of some texts in one line, hashed: for each place, its shingle's hash, and for each window start the
    smallest shingle hash in the window (its anchor). Equal windows have equal anchors, at equal places."""

    def __init__(self, texts: list[list[bytes]], window: int, shingle: int):
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        n = int(self.lengths.sum())
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(texts)), np.uint64, n)
        doc = np.repeat(np.arange(len(texts)), self.lengths)
        self.doc, self.place = doc, np.arange(n) - self.starts[doc] if n else np.zeros(0, np.int64)
        left = self.lengths[doc] - self.place if n else np.zeros(0, np.int64)
        self.is_start = left >= window
        inside = window - shingle + 1  # shingles of a window
        self.inside = inside
        self.shingles = np.minimum(_scramble(_chained(self.hashes, shingle)), _TOP - np.uint64(1)) if n else self.hashes
        low = _sliding(self.shingles, inside, np.minimum, lambda a, s: _ahead(a, s, int(_TOP)))
        self.anchor = np.where(self.is_start, low, np.uint64(0))

    def chosen(self) -> np.ndarray:
        """Places whose shingle is the anchor of a window around it."""
        high = _sliding(self.anchor, self.inside, np.maximum, _behind)
        return (high == self.shingles) & (high > 0)


def _chunks(words: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, w in enumerate(words):
        size += len(w)
        if size >= CHUNK_WORDS:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(words):
        yield at, len(words)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, as they are moved twice."""
    pack = zstandard.ZstdCompressor(level=1, write_content_size=True).compress
    for batch in batches:
        body = [pack(t.as_py() or b"") for t in batch.column("body").cast(pa.large_binary())]
        at = batch.schema.get_field_index("body")
        columns = [pa.array(body, pa.binary()) if i == at else c for i, c in enumerate(batch.columns)]
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def _split(column) -> Iterator[tuple[int, int, list[list[bytes]]]]:
    """Texts a to b as words, no more texts at a time than CHUNK_WORDS need."""
    part, at, size = [], 0, 0
    for i, t in enumerate(column.cast(pa.large_binary())):
        part.append((t.as_py() or b"").split())
        size += len(part[-1])
        if size >= CHUNK_WORDS:
            yield at, i + 1, part
            part, at, size = [], i + 1, 0
    if part:
        yield at, at + len(part), part


def _unpacked(column) -> list[list[bytes]]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(t).split() for t in column.to_pylist()]


def _phrases(window: int, shingle: int):
    """(phrase, shard, n): the phrases that each shard's texts are to be looked up by, as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = batch.column("shard").to_numpy(zero_copy_only=False)
            for a, b, words in _split(batch.column("body")):
                w = Words(words, window, shingle)
                at = np.flatnonzero(w.chosen())
                pairs = np.empty(len(at), [("phrase", np.int64), ("shard", np.int32)])
                pairs["phrase"], pairs["shard"] = w.shingles[at].view(np.int64), shards[a:b][w.doc[at]]
                found, n = np.unique(pairs, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found["phrase"]), pa.array(found["shard"]), pa.array(n.astype(np.int64))],
                    names=["phrase", "shard", "n"],
                )

    return run


_STRETCH = pa.schema(
    [
        ("deal", pa.int64()),
        ("hot", pa.bool_()),
        ("shard", pa.int32()),
        ("ord", pa.int64()),
        ("text", pa.int64()),
        ("start", pa.int32()),
        ("n", pa.int32()),
        ("words", pa.binary()),
    ]
)


def _stretches(window: int, shingle: int, deals: int):
    """The stretches of a shard's documents around recurring phrases: successive windows with one phrase as anchor,
    with their words. ``deal`` says which automaton they are streamed through: the phrase's own, or for a phrase with
    very many rows one of several that share its work.

    Of equal stretches in the shard only the first goes on: all windows of the others start earlier too, and they
    come out without words."""

    def run(key, docs: pa.Table, phrases: pa.Table) -> pa.Table:
        if not docs.num_rows or not phrases.num_rows:
            return _STRETCH.empty_table()
        docs = docs.sort_by("ord")
        words, order = _unpacked(docs.column("body")), docs.column("ord").to_numpy()
        texts = docs.column("text").to_numpy()
        known = phrases.column("phrase").to_numpy()
        by_hash = np.argsort(known)
        known, parts = known[by_hash], phrases.column("parts").to_numpy()[by_hash]
        seen: dict[bytes, tuple[int, int]] = {}
        out: list[tuple] = []
        for a, b in _chunks(words):
            w = Words(words[a:b], window, shingle)
            anchor = w.anchor.view(np.int64)
            place = np.minimum(np.searchsorted(known, anchor), len(known) - 1)
            at = np.flatnonzero(w.is_start & (known[place] == anchor))
            if not len(at):
                continue
            begins = np.flatnonzero(
                np.concatenate([[True], (np.diff(at) != 1) | (anchor[at[1:]] != anchor[at[:-1]]) | (w.doc[at[1:]] != w.doc[at[:-1]])])
            )
            begin = at[begins]
            sizes = np.diff(np.concatenate([begins, [len(at)]]))
            row, split = w.doc[begin] + a, parts[place[begin]]
            spread = _scramble(order[row].astype(np.uint64) + np.uint64(1)) % split.astype(np.uint64)
            own = _scramble(anchor[begin].view(np.uint64) + spread * _MIX)
            # the top bit keeps deals of their own apart from the shared ones
            deal = np.where(split > 1, (own | np.uint64(1 << 63)).view(np.int64), (own % np.uint64(deals)).view(np.int64))
            runs = (row, w.place[begin], sizes, order[row], texts[row], deal, split > 1)
            for r, p, n, doc, text, to, hot in zip(*(x.tolist() for x in runs), strict=True):
                stretch = b" ".join(words[r][p : p + n + window - 1])
                first = seen.setdefault(stretch, (doc, p))
                if first == (doc, p):
                    out.append((to, hot, doc, text, p, n, stretch))
                else:
                    out.append(((doc + p) % deals, False, doc, text, p, n, None))
        if not out:
            return _STRETCH.empty_table()
        to, hot, doc, text, place, n, stretch = zip(*out, strict=True)
        shard = [key[0].as_py()] * len(out)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip((to, hot, shard, doc, text, place, n, stretch), _STRETCH, strict=True)], schema=_STRETCH)

    return run


class Codes(dict):
    """Words to strings of ``digits`` characters, blanks for words that no phrase has.

    A node of an automaton looks its successors up one by one, so letters are few: a word is a number in base 64, and
    each digit's place has letters of its own, so that phrases match at whole words only."""

    def __init__(self, vocabulary: list[bytes]):
        self.digits = 1
        while 64**self.digits < len(vocabulary):
            self.digits += 1
        self.blank = "\0" * self.digits
        super().__init__(
            (w, "".join(chr(1 + 64 * d + (i >> 6 * d) % 64) for d in range(self.digits))) for i, w in enumerate(vocabulary)
        )

    def __missing__(self, word: bytes) -> str:
        return self.blank

    def of(self, words: list[bytes]) -> str:
        return "".join(map(self.__getitem__, words))


def _recurring(codes: list[str], digits: int, hot: np.ndarray, window: int) -> list[str]:
    """The passages to look for, as codes: the longest series of successive windows in the stretches that each occur
    twice or more among them, or that must be looked for because their phrase's stretches are dealt to several
    automata. Hashes nominate; the automaton then compares the words themselves."""
    sizes = np.array([len(c) // digits for c in codes], np.int64)
    begin = np.cumsum(sizes) - sizes
    letters = np.frombuffer("".join(codes).encode("utf-32-le"), np.uint32).reshape(-1, digits)
    word = np.zeros(len(letters), np.uint64)
    for d in range(digits):
        word = _scramble(word + letters[:, d] + np.uint64(1))
    of = np.repeat(np.arange(len(codes)), sizes)
    starts = np.arange(len(word)) - begin[of] <= sizes[of] - window
    content = _chained(word, window)
    _, inverse, count = np.unique(content[starts], return_inverse=True, return_counts=True)
    wanted = np.zeros(len(word), bool)
    wanted[starts] = (count[inverse] > 1) | hot[of[starts]]
    at = np.flatnonzero(wanted)
    if not len(at):
        return []
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (of[at[1:]] != of[at[:-1]])]))
    first, n = at[new], np.diff(np.concatenate([new, [len(at)]]))
    return list(
        {
            codes[i][p * digits : (p + m + window - 1) * digits]
            for i, p, m in zip(of[first].tolist(), (first - begin[of[first]]).tolist(), n.tolist(), strict=True)
        }
    )


def _located(codes: list[str], passages: list[str], digits: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, place, window) for every occurrence of a window of the passages in the stretches: an Aho-Corasick
    automaton of the passages finds all places, and equal windows have equal numbers."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    number: dict[str, int] = {}
    windows, lengths = [], np.empty(len(passages), np.int64)
    for k, passage in enumerate(passages):
        automaton.add_word(passage, k)
        lengths[k] = n = len(passage) // digits - window + 1
        for p in range(n):
            windows.append(number.setdefault(passage[p * digits : (p + window) * digits], len(number)))
    automaton.make_automaton()
    numbers, offset = np.array(windows, np.int64), np.cumsum(lengths) - lengths
    stretch, end, found = [], [], []
    for i, text in enumerate(codes):
        for e, k in automaton.iter(text):
            stretch.append(i)
            end.append(e)
            found.append(k)
    stretch, end, found = (np.array(x, np.int64) for x in (stretch, end, found))
    n = lengths[found]
    begin = (end + 1) // digits - (n + window - 1)
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(stretch, n), np.repeat(begin, n) + step, numbers[np.repeat(offset[found], n) + step]
    _, once = np.unique(at[0] << np.int64(32) | at[1], return_index=True)  # passages may overlap
    return at[0][once], at[1][once], at[2][once]


_LATE = pa.schema(
    [("shard", pa.int32()), ("ord", pa.int64()), ("text", pa.int64()), ("start", pa.int32()), ("late", pa.binary()), ("window", pa.binary())]
)


def _settle(window: int):
    """Streams the stretches of a deal through the automaton of its recurring passages. Gives (shard, ord, text, start,
    late): a byte for each successive window, 1 if it also starts earlier. Where a phrase is dealt to several
    automata, the first of equal windows in each comes out as a row with the window's words instead."""

    def run(key, table):
        whole = table.filter(table.column("words").is_null())
        parts = []
        if whole.num_rows:
            late = pa.array([b"\x01" * n for n in whole.column("n").to_pylist()], pa.binary())
            parts.append(pa.Table.from_arrays([*(whole.column(c) for c in ("shard", "ord", "text", "start")), late, pa.nulls(len(late), pa.binary())], schema=_LATE))
        table = table.filter(table.column("words").is_valid())
        if table.num_rows:
            texts = [t.split(b" ") for t in table.column("words").to_pylist()]
            spell = Codes(list(dict.fromkeys(chain.from_iterable(texts))))
            codes, hot = [spell.of(t) for t in texts], table.column("hot").to_numpy()
            passages = _recurring(codes, spell.digits, hot, window)
            if passages:
                parts += decided(table, texts, hot, *_located(codes, passages, spell.digits, window))
        return pa.concat_tables(parts) if parts else _LATE.empty_table()

    def decided(table, texts, hot, stretch, place, number) -> Iterator[pa.Table]:
        doc, start = table.column("ord").to_numpy(), table.column("start").to_numpy().astype(np.int64)
        d, p = doc[stretch], start[stretch] + place
        order = np.lexsort((p, d, number))
        same = np.concatenate([[False], number[order][1:] == number[order][:-1]])
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        late = np.zeros(len(order), bool)
        late[order] = (d[order] != d[order][first]) | (p[order] != p[order][first])
        sizes = table.column("n").to_numpy().astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        marks = np.zeros(int(sizes.sum()), np.uint8)
        marks[begin[stretch] + place] = late
        some = np.flatnonzero(np.add.reduceat(marks, begin, dtype=np.int64) > 0)
        data = marks.tobytes()
        picked = table.select(["shard", "ord", "text", "start"])
        bits = pa.array([data[begin[i] : begin[i] + sizes[i]] for i in some.tolist()], pa.binary())
        yield pa.Table.from_arrays([*picked.take(pa.array(some)).columns, bits, pa.nulls(len(some), pa.binary())], schema=_LATE)
        ahead = np.flatnonzero(hot[stretch] & ~late)
        if len(ahead):
            rows = picked.take(pa.array(stretch[ahead]))
            at = place[ahead]
            full = [b" ".join(texts[i][q : q + window]) for i, q in zip(stretch[ahead].tolist(), at.tolist(), strict=True)]
            starts = pa.array((rows.column("start").to_numpy() + at).astype(np.int32))
            yield pa.Table.from_arrays([rows.column("shard"), rows.column("ord"), rows.column("text"), starts, pa.nulls(len(full), pa.binary()), pa.array(full, pa.binary())], schema=_LATE)

    return run


def _remove(window: int, schema: pa.Schema):
    def run(key, docs: pa.Table, late: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        cover: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
        for o, t, s, b in zip(*(late.column(c).to_pylist() for c in ("ord", "text", "start", "late")), strict=True):
            cover.setdefault((o, t), []).append((s, b))
        n_words, n_removed, kept = [], [], []
        for o, t, words in zip(*(docs.column(c).to_pylist() for c in ("ord", "text")), _unpacked(docs.column("body")), strict=True):
            gone = np.zeros(len(words) + 1, np.int64)
            for s, b in cover.get((o, t), ()):
                at = np.flatnonzero(np.frombuffer(b, np.uint8)) + s
                np.add.at(gone, at, 1)
                np.add.at(gone, at + window, -1)
            covered = np.cumsum(gone[:-1]) > 0
            n_words.append(len(words))
            n_removed.append(int(covered.sum()))
            kept.append(b" ".join([w for w, g in zip(words, covered.tolist(), strict=True) if not g] if n_removed[-1] else words).decode())
        return pa.Table.from_arrays([docs.column("id").combine_chunks(), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], schema=schema)

    return run


def _numbered(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, ord) of the distinct ids that aren't integers: their places in order."""
    ids = docs.select(col(id_col).alias("id")).where("id is not null").distinct()
    return cut(with_prefix(ids, ["id"], {}, "ord"), "ids").select(F.col("id").alias("known"), "ord")


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
    shard_bytes: int = SHARD_BYTES,
    deal_bytes: int = DEAL_BYTES,
    deal_rows: int = DEAL_ROWS,
) -> DataFrame:
    """(id, n_words, n_removed, kept_text): each text without the words of windows that also start earlier.

    A window is ``window`` successive words; it starts earlier if its words also do in a document with a smaller id,
    or in the same one further ahead. Steps:

    1. Winnowing picks phrases of ``shingle`` words such that equal windows contain an equal phrase at an equal place.
       Phrases picked twice or more anywhere may recur; every shard of documents is told which it has.
    2. All documents are searched for these phrases, and the stretches of windows around them are dealt by phrase.
    3. Each deal confirms which windows recur, compiles the recurring passages into an Aho-Corasick automaton over
       words, and streams its stretches through it. The automaton compares words, not hashes, and locates every
       occurrence; order decides which start earlier.
    4. Shards drop the words of those windows.

    A place can only hold passages with its own phrase, so that streaming it through that phrase's automaton alone
    finds what streaming it through all of them would, at a cost that grows with the input and not with its square.

    A phrase in more than ``deal_rows`` places is dealt to several automata by document; the first of equal windows in
    each meet in a window function, a row for each automaton. A shard sends on one of equal stretches. Documents are
    dealt to shards by hash of id and text, so copies spread.

    Ids of any type that can be ordered will do. Equal ids are one document for "earlier": of rows repeated under one
    id, none is earlier by its place alone. Null ids come last and are one. Null texts have no words. An empty table
    gives an empty table; other columns are ignored."""
    kind = docs.schema[id_col].dataType
    light = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("body"))
    if isinstance(kind, T.IntegralType):
        light = light.withColumn("ord", F.col("id").cast("bigint"))
    else:
        light = light.join(_numbered(docs, id_col), F.col("id") == F.col("known"), "left")
    total = light.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    shards, deals = max(1, math.ceil(total / shard_bytes)), max(1, math.ceil(total / deal_bytes))
    light = light.select("id", F.coalesce("ord", F.lit((1 << 63) - 1)).alias("ord"), "body", F.xxhash64("body").alias("text"))
    light = light.withColumn("shard", F.pmod(F.xxhash64("ord", "text"), F.lit(shards)).cast("int"))
    picked = light.select("shard", "body").mapInArrow(_phrases(window, shingle), "phrase long, shard int, n long")
    # a phrase has a row for each shard here, however many documents have it
    counted = picked.withColumn("times", F.sum("n").over(Window.partitionBy("phrase"))).where("times > 1")
    recurring = counted.select("shard", "phrase", F.ceil(F.col("times") / deal_rows).cast("bigint").alias("parts"))
    packed = light.mapInArrow(_pack, T.StructType([T.StructField("body", T.BinaryType()) if f.name == "body" else f for f in light.schema]))
    stretches = (
        packed.select("shard", "ord", "text", "body")
        .groupBy("shard")
        .cogroup(recurring.groupBy("shard"))
        .applyInArrow(_stretches(window, shingle, deals), "deal long, hot boolean, shard int, ord long, text long, start int, n int, words binary")
    )
    settled = cut(
        stretches.groupBy("deal").applyInArrow(_settle(window), "shard int, ord long, text long, start int, late binary, window binary"), "settled"
    )
    place = F.struct("ord", "start")
    ahead = F.min(place).over(Window.partitionBy("window"))
    across = settled.where("window is not null").withColumn("first", ahead).where(place > F.col("first")).withColumn("late", F.lit(b"\x01"))
    columns = ["shard", "ord", "text", "start", "late"]
    late = settled.where("window is null").select(*columns).unionByName(across.select(*columns))
    out = pa.schema([pa.field("id", _arrow(kind)), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])
    done = (
        packed.groupBy("shard")
        .cogroup(late.groupBy("shard"))
        .applyInArrow(_remove(window, out), T.StructType([T.StructField("id", kind), *T._parse_datatype_string("n_words long, n_removed long, kept_text string")]))
    )
    return done.withColumnRenamed("id", id_col)
