"""Token ids in binary files, compressed by grammar (Re-Pair), with random access.

Texts are encoded with a public word-level BPE of the tokenizers library, dealt by ranges of doc_id, sorted, and written by
one task per range. A task cuts its ids in shards of SHARD ids; documents may span shards. In each shard the most frequent pairs of
neighbouring symbols are replaced by nonterminals, again and again, until no pair occurs LEAST times. A round replaces all
pairs that are frequent at that time (where two occurrences overlap, the more frequent pair wins), so a shard needs
few passes instead of one per rule. A shard stores its rules, the number of ids each rule expands to, and at every STEP-th
symbol the position it begins at, so any range of ids is decoded from a few symbols.

File, little-endian: shards; then the documents' ids, null marks and sizes; then each shard's place and first id; then TAIL.
Shard: HEAD, rules (two symbols each), expansion lengths (u32), positions (u32), symbols. A symbol takes two bytes where
vocabulary and rules fit, else four. index.json, written at commit, names the files in order with their first ids.

Defined results: null and empty texts have the end id alone; rows go by doc_id (null first), equal doc_ids by the xxhash64 of
their text, so equal rows are interchangeable; texts of any length are encoded whole; an empty table gives files without
documents; other columns are ignored. A doc_id with a large share of the rows is dealt to several files by that hash.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import in_slices, scratch, shuffle_parts, table
from .warc import file_system

END = 2
#: Ids of a shard; occurrences a pair needs to become a rule; symbols between two stored positions.
SHARD, LEAST, STEP = 1 << 20, 16, 1024
#: Rounds of replacement in a shard at most: more change the size by little, and never the ids.
ROUNDS = 4
#: Documents of a file at most, about.
FILE_DOCS = 1 << 18
#: Words that a worker remembers; the table is emptied when full, which changes no result. Bytes of text encoded at once.
CACHE, SLICE = 500_000, 16 << 20
MAGIC = b"RPS1"
HEAD, TAIL = struct.Struct("<4sIIIIIB3x"), struct.Struct("<QQQ4s4x")
#: Slots of the table that finds a position's rule, a power of two.
SLOTS = 18

# The vocabulary's pre-token pattern, and the characters whose lower case and composition are the same everywhere.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SIMPLE = r"[\x21-\x7eÀ-ÖØ-öø-įı-ňŊ-ž]*"


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class WordTokens:
    """Ids of whole texts. White space separates pre-tokens and is dropped, so each word has its ids by itself.

    Words of simple characters are lower-cased and split into pre-tokens here, and the library's model encodes those of
    each new word; all other words, and those that may hold a special token, go through the library's whole encoder.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.simple, self.split = regex.compile(SIMPLE).fullmatch, regex.compile(PATTERN).findall
        self.visible = dict(enumerate(byte_characters()))
        self.size = max(self.whole.get_vocab_size(), END + 1)
        self.words: dict[str, tuple[int, ...]] = {}

    def pre_token(self, pre: str) -> tuple[int, ...]:
        mapped = pre if pre.isascii() else pre.encode().decode("latin-1").translate(self.visible)
        return tuple(t.id for t in self.model.tokenize(mapped))

    def word(self, word: str) -> tuple[int, ...]:
        if word.isascii() and word.isalpha():
            return self.pre_token(word.lower())
        if "<|" in word or not self.simple(word):
            return tuple(self.whole.encode(word, add_special_tokens=False).ids)
        return tuple(chain.from_iterable(map(self.pre_token, self.split(word.lower()))))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each text with the end id, and how many each has."""
        texts = pc.fill_null(texts, "")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            # fewer distinct words: no capitals, and the signs that end a word by themselves
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z])([.,;:!?]+[\t-\r ])", r"\1 \2")
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        known, found = self.words, []
        for word in coded.dictionary.to_numpy(zero_copy_only=False).tolist():
            ids = known.get(word)
            if ids is None:
                if len(known) >= CACHE:
                    known.clear()
                ids = known[word] = self.word(word)
            found.append(ids)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        which = coded.indices.to_numpy(zero_copy_only=False)
        ids = gathered(flat, np.cumsum(sizes) - sizes, sizes, which)
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        ends = np.concatenate([[0], np.cumsum(sizes[which])])[bounds]
        return np.insert(ids, ends[1:], END), np.diff(ends) + 1


@lru_cache(1)
def known_words(path: str) -> WordTokens:
    """One encoder for all tasks of a worker, with the words it has met."""
    return WordTokens(path)


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs flat[starts[w] : starts[w] + sizes[w]] of all w in which, one after another."""
    n = sizes[which]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts[which] - (ends - n), n)]


@dataclass
class Grammar:
    """symbols below base are ids; base + r expands to the two symbols of rules[r], lengths[r] ids in all."""

    base: int
    rules: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones(self.base, np.int64), self.lengths.astype(np.int64)])[symbols]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of some of the symbols. Rules refer to earlier rules only, so each expansion is two known ones."""
        needed = np.unique(symbols[symbols >= self.base]).tolist()
        seen = set(needed)
        for s in needed:  # grows while it is read
            for half in self.rules[s - self.base].tolist():
                if half >= self.base and half not in seen:
                    seen.add(half)
                    needed.append(half)
        spelled: dict[int, list[int]] = {}
        for s in sorted(seen):
            a, b = self.rules[s - self.base].tolist()
            spelled[s] = (spelled[a] if a >= self.base else [a]) + (spelled[b] if b >= self.base else [b])
        order = sorted(spelled)
        flat = np.concatenate([np.arange(self.base, dtype=np.uint32), np.fromiter(chain.from_iterable(map(spelled.get, order)), np.uint32)])
        sizes = np.ones(self.base + len(self.rules), np.int64)
        sizes[order] = [len(spelled[s]) for s in order]
        starts = np.arange(self.base + len(self.rules), dtype=np.int64)
        starts[order] = self.base + np.cumsum(sizes[order]) - sizes[order]
        return gathered(flat, starts, sizes, symbols)


def re_pair(ids: np.ndarray, base: int, least: int = LEAST, rounds: int = ROUNDS) -> Grammar:
    """The grammar of a shard; ids are below base."""
    most = (1 << 16) - base if base < 1 << 16 else 1 << 20
    symbols, rules, lengths = ids.astype(np.int64), [np.zeros((0, 2), np.int64)], np.ones(base, np.int64)
    for _ in range(rounds):
        room = most - (len(lengths) - base)
        counts = np.bincount(symbols, minlength=len(lengths))
        frequent = np.flatnonzero(counts >= least)[: (1 << 16) - 1]
        rank = np.zeros(len(lengths), np.uint32)
        rank[frequent] = np.arange(1, len(frequent) + 1)  # 0: in no frequent pair
        r = rank[symbols]
        keys = (r[:-1] << np.uint32(16)) | r[1:]
        both = (r[:-1] > 0) & (r[1:] > 0)
        pairs = np.sort(keys[both])
        if not room or not len(pairs):
            break
        first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        n = np.diff(np.append(first, len(pairs)))
        often = np.flatnonzero(n >= least)
        often = often[np.argsort(-n[often], kind="stable")][:room]
        slot = lambda k: (k * np.uint32(2_654_435_761)) >> np.uint32(32 - SLOTS)
        chosen = pairs[first[often]]
        rule_at = np.full(1 << SLOTS, -1, np.int32)
        rule_at[slot(chosen)[::-1]] = np.arange(len(chosen), dtype=np.int32)[::-1]  # of pairs that share a slot the most frequent waits no round
        chosen = np.append(chosen, np.uint32(0))  # rank 0 is in no pair, so -1 finds nothing
        rule = rule_at[slot(keys)]
        rule[(chosen[rule] != keys) | (rule < 0)] = len(chosen)
        left, right = np.append(len(chosen), rule[:-1]), np.append(rule[1:], len(chosen))
        # in a run of one symbol every second place takes part, from the first one that a better pair on its left leaves free
        place = np.arange(len(rule))
        begin = np.maximum.accumulate(np.where(rule != left, place, 0))
        since = place - begin - (left[begin] < rule)
        at = np.flatnonzero((rule < len(chosen)) & (since >= 0) & (since % 2 == 0) & (rule <= right))
        used, number = np.unique(rule[at], return_inverse=True)
        if not len(used):
            break
        new = np.stack([frequent[(chosen[used] >> np.uint32(16)) - 1], frequent[(chosen[used] & np.uint32(0xFFFF)) - 1]], axis=1)
        symbols[at] = len(lengths) + number
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols = symbols[keep]
        lengths = np.concatenate([lengths, lengths[new].sum(axis=1)])
        rules.append(new)
    return Grammar(base, np.concatenate(rules), lengths[base:].astype(np.uint32), symbols)


def pack(g: Grammar, step: int = STEP) -> bytes:
    width = 2 if g.base + len(g.rules) <= 1 << 16 else 4
    kind = f"<u{width}"
    ends = np.cumsum(g.sizes(g.symbols))
    begins = np.concatenate([[0], ends[:-1]])[::step] if len(ends) else ends
    head = HEAD.pack(MAGIC, int(ends[-1]) if len(ends) else 0, len(g.symbols), len(g.rules), g.base, step, width)
    return head + g.rules.astype(kind).tobytes() + g.lengths.astype("<u4").tobytes() + begins.astype("<u4").tobytes() + g.symbols.astype(kind).tobytes()


class Shard:
    """A stored shard in an open file, at a place in it."""

    def __init__(self, file, at: int) -> None:
        self.file = file
        file.seek(at)
        magic, self.n_ids, self.n_symbols, n_rules, base, self.step, self.width = HEAD.unpack(file.read(HEAD.size))
        if magic != MAGIC:
            raise ValueError(f"no shard at byte {at}")
        kind = f"<u{self.width}"
        rules = np.frombuffer(file.read(2 * n_rules * self.width), kind).reshape(-1, 2)
        lengths = np.frombuffer(file.read(4 * n_rules), "<u4")
        self.begins = np.frombuffer(file.read(4 * -(-self.n_symbols // self.step)), "<u4")
        self.symbols_at = at + HEAD.size + 2 * n_rules * self.width + 4 * n_rules + 4 * len(self.begins)
        self.grammar = Grammar(base, rules, lengths, np.zeros(0, np.int64))

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """ids start .. end - 1; reads the symbols between the stored positions around them."""
        end = self.n_ids if end is None else end
        if start >= end:
            return np.zeros(0, np.uint32)
        first = int(np.searchsorted(self.begins, start, side="right")) - 1
        last = int(np.searchsorted(self.begins, end, side="left"))
        self.file.seek(self.symbols_at + first * self.step * self.width)
        count = min(self.n_symbols, last * self.step) - first * self.step
        symbols = np.frombuffer(self.file.read(count * self.width), f"<u{self.width}").astype(np.int64)
        skip = start - int(self.begins[first])
        return self.grammar.expand(symbols)[skip : skip + end - start]


class TokenFile:
    """A stored file: its documents, and the ids of any range."""

    def __init__(self, file, size: int) -> None:
        self.file = file
        file.seek(size - TAIL.size)
        n_docs, n_shards, at, magic = TAIL.unpack(file.read(TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a file of token shards")
        file.seek(at)
        read = lambda kind, n: np.frombuffer(file.read(n * np.dtype(kind).itemsize), kind)
        self.doc_ids, self.known, self.sizes = read("<i8", n_docs), read("u1", n_docs), read("<i8", n_docs)
        self.places, self.firsts = read("<u8", n_shards).astype(np.int64), read("<u8", n_shards).astype(np.int64)

    def ids(self, start: int, end: int) -> np.ndarray:
        """ids start .. end - 1 of the file."""
        out = [np.zeros(0, np.uint32)]
        for k in range(max(0, int(np.searchsorted(self.firsts, start, side="right")) - 1), int(np.searchsorted(self.firsts, end, side="left"))):
            shard, first = Shard(self.file, int(self.places[k])), int(self.firsts[k])
            out.append(shard.ids(max(0, start - first), min(shard.n_ids, end - first)))
        return np.concatenate(out)


@dataclass
class Written(WriterCommitMessage):
    part: int
    temporary: str
    n_docs: int
    n_ids: int


class TokenWriter(DataSourceArrowWriter):
    """Sorted rows (doc_id, ids binary) to one file a task; files are named and listed when all tasks are done."""

    def __init__(self, options) -> None:
        self.path, self.run = options["path"], uuid.uuid4().hex[:12]
        self.base, self.width, self.shard, self.step = (int(options[k]) for k in ("vocabulary", "bytes", "shard", "step"))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, path = file_system(self.path)
        store.create_dir(path, recursive=True)
        part = TaskContext.get().partitionId()
        temporary = f"{path}/_{self.run}-{part}-{uuid.uuid4().hex}"
        doc_ids, known, sizes, places, firsts, held = [], [], [], [], [], []
        at = done = waiting = 0
        try:
            with store.open_output_stream(temporary) as out:

                def close(ids: np.ndarray) -> None:
                    nonlocal at, done
                    packed = pack(re_pair(ids, self.base), self.step)
                    places.append(at)
                    firsts.append(done)
                    out.write(packed)
                    at, done = at + len(packed), done + len(ids)

                for batch in batches:
                    doc_id, binary = batch.column("doc_id"), batch.column("ids")
                    doc_ids.append(pc.fill_null(doc_id, 0).to_numpy(zero_copy_only=False))
                    known.append(doc_id.is_valid().to_numpy(zero_copy_only=False))
                    sizes.append(pc.binary_length(binary).to_numpy(zero_copy_only=False) // self.width)
                    for x in binary:
                        held.append(np.frombuffer(x.as_buffer(), f"<u{self.width}"))
                        waiting += len(held[-1])
                        if waiting >= self.shard:
                            whole = np.concatenate(held)
                            for a in range(0, waiting - self.shard + 1, self.shard):
                                close(whole[a : a + self.shard])
                            held, waiting = [whole[waiting - waiting % self.shard :].copy()], waiting % self.shard
                if waiting:
                    close(np.concatenate(held))
                joined = lambda xs, kind: np.concatenate([np.zeros(0, kind), *xs]).astype(kind)
                n = sum(map(len, sizes))
                for x in (joined(doc_ids, "<i8"), joined(known, "u1"), joined(sizes, "<i8"), np.array(places, "<u8"), np.array(firsts, "<u8")):
                    out.write(x.tobytes())
                out.write(TAIL.pack(n, len(places), at, MAGIC))
        except BaseException:
            store.delete_file(temporary)
            raise
        return Written(part, temporary, n, done)

    def commit(self, messages) -> None:
        store, path = file_system(self.path)
        files, first = [], 0
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.part):
            name = f"part-{m.part:06d}-{self.run}.ids"
            store.move(m.temporary, f"{path}/{name}")
            files.append({"file": name, "first_id": first, "n_docs": m.n_docs, "n_ids": m.n_ids})
            first += m.n_ids
        with store.open_output_stream(f"{path}/index.json") as out:
            out.write(json.dumps(files).encode())
        self.abort(messages)

    def abort(self, messages) -> None:
        """Removes what attempts of this run have left, as of lost executors."""
        from pyarrow import fs

        store, path = file_system(self.path)
        for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if f.base_name.startswith(f"_{self.run}-"):
                store.delete_file(f.path)


@dataclass
class OneFile(InputPartition):
    name: str
    first_id: int


class TokenReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.ids = options["path"], options.get("ids", "true") == "true"

    def partitions(self) -> list[OneFile]:
        store, path = file_system(self.path)
        with store.open_input_file(f"{path}/index.json") as file:
            return [OneFile(f["file"], f["first_id"]) for f in json.loads(file.read()) if f["n_docs"]] or [OneFile("", 0)]

    def read(self, part: OneFile) -> Iterator[pa.RecordBatch]:
        if not part.name:
            return
        store, path = file_system(self.path)
        size = store.get_file_info(f"{path}/{part.name}").size
        with store.open_input_file(f"{path}/{part.name}") as file:
            stored = TokenFile(file, size)
            starts = np.cumsum(stored.sizes) - stored.sizes
            rows: list[tuple] = []
            doc, left, crc, kept = 0, int(stored.sizes[0]), 0, []
            for place in stored.places.tolist():
                ids = Shard(file, place).ids().astype("<u4")
                a = 0
                while a < len(ids):
                    take = ids[a : a + left]
                    crc = zlib.crc32(take, crc)
                    if self.ids:
                        kept.append(take)
                    a, left = a + len(take), left - len(take)
                    if not left:
                        rows.append((doc, crc, np.concatenate(kept).view("<i4") if self.ids else None))
                        doc, crc, kept = doc + 1, 0, []
                        left = int(stored.sizes[doc]) if doc < len(stored.sizes) else 0
                yield self._batch(stored, starts + part.first_id, rows)
                rows = []

    def _batch(self, stored: TokenFile, starts: np.ndarray, rows: list[tuple]) -> pa.RecordBatch:
        at = np.array([r[0] for r in rows], np.int64)
        columns = [
            pa.array(stored.doc_ids[at], pa.int64(), mask=stored.known[at] == 0),
            pa.array(starts[at], pa.int64()),
            pa.array(stored.sizes[at], pa.int64()),
            pa.array([r[1] for r in rows], pa.int64()),
        ]
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        if self.ids:
            columns.append(pa.array([r[2] for r in rows], pa.list_(pa.int32())))
            names.append("token_ids")
        return pa.RecordBatch.from_arrays(columns, names)


class TokenDataSource(DataSource):
    """spark.read.format("token_files").load(path): doc_id, start, n_tokens, ids_crc32 and, unless option ids is false, token_ids."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids_crc32 long" + ", token_ids array<int>" * (self.options.get("ids", "true") == "true")

    def reader(self, schema) -> TokenReader:
        return TokenReader(self.options)

    def writer(self, schema, overwrite: bool) -> TokenWriter:
        return TokenWriter(self.options)


def dealer(docs: DataFrame):
    """(part of each row from its doc_id and hash, number of parts): ranges of doc_id with about as many rows each."""
    n, nulls = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    parts = max(shuffle_parts(docs.sparkSession), -(-n // FILE_DOCS))
    shares = [i / parts for i in range(1, parts)]
    found = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * parts)).alias("x")).first().x if shares else []
    bounds, first = np.array(found or [], np.int64), max(1, -(-nulls * parts // max(n, 1))) if nulls else 0

    def deal(doc_id: pa.Array, tie: pa.Array) -> np.ndarray:
        share = (tie.to_numpy(zero_copy_only=False).astype(np.float64) + 2.0**63) / 2.0**64
        ids = pc.fill_null(doc_id, 0).to_numpy(zero_copy_only=False)
        low, high = np.searchsorted(bounds, ids, side="left"), np.searchsorted(bounds, ids, side="right")
        within = lambda wide: np.minimum((share * wide).astype(np.int64), np.maximum(wide - 1, 0))
        return np.where(doc_id.is_valid().to_numpy(zero_copy_only=False), first + low + within(high - low), within(np.full(len(ids), first)))

    return deal, parts + first


def write_tokens(docs: DataFrame, vocabulary: str, path: str, shard: int = SHARD, step: int = STEP) -> None:
    """Encodes docs (doc_id, text) and writes their ids below path, in ascending doc_id order. vocabulary must be readable by every executor."""
    from tokenizers import Tokenizer

    base = max(Tokenizer.from_file(vocabulary).get_vocab_size(), END + 1)
    width = 2 if base <= 1 << 16 else 4
    deal, parts = dealer(docs)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = known_words(vocabulary)
        for whole in batches:
            for b in in_slices(whole, most=SLICE):
                ids, sizes = coder.encode(b.column("text"))
                offsets = np.concatenate([[0], np.cumsum(sizes * width)]).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(f"<u{width}"))])
                part = pa.array(deal(b.column("doc_id"), b.column("tie")), pa.int32())
                yield pa.RecordBatch.from_arrays([part, b.column("doc_id"), b.column("tie"), binary], ["part", "doc_id", "tie", "ids"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    coded = rows.mapInArrow(encode, "part int, doc_id long, tie long, ids binary")
    dealt = coded.repartitionById(parts, F.col("part")).sortWithinPartitions("doc_id", "tie").select("doc_id", "ids")
    docs.sparkSession.dataSource.register(TokenDataSource)
    options = {"vocabulary": base, "bytes": width, "shard": shard, "step": step}
    dealt.write.format("token_files").options(**options).mode("append").save(path)


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    spark.dataSource.register(TokenDataSource)
    return spark.read.format("token_files").option("ids", str(ids).lower()).load(path)


def public_words() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), public_words(), path)
    return read_tokens(spark, path, ids=False)
