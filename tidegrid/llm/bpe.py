"""BPE encoding and decoding by a tokenization automaton.

The automaton accepts exactly the token sequences that BPE makes, one for each byte string. It starts as
one state with an arc for each byte, and takes in the merges in their order. The gadget of a merge of a and
b into c is: wherever an arc a leads to a state with an arc b, c gets an arc that spans both; and the state
behind a is copied without its arc b, so that a, b in a row is no longer accepted. What a state allows
depends on the last token alone, so states and arcs are kept as classes: tokens that may be followed by the
same tokens share a row of the table, tokens that may follow the same ones share a column, and a class is
split (copied) only when a merge changes one of its tokens.

Encoding reads a pre-split word byte by byte with two tables: one of byte transitions, whose nodes tell the arcs that end
at a position, and that of the classes. Every prefix has one accepted sequence, so at every position exactly one arc may follow
the state it starts from; it is looked up, and nothing is taken back. Decoding emits the labels of the arcs. The tables are
compiled once, by one task, and sent to the workers.
"""

from __future__ import annotations

import hashlib
import json
import pickle
from collections.abc import Iterator
from functools import cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import bounded_batches

#: Fixed value: the pattern of byte-level pre-splitting; white space is Unicode's White_Space.
WHITE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
CACHE_WORDS, CACHE_LENGTH = 250_000, 48
LONG = 1 << 20  # characters of a text that is encoded block by block


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in a byte-level vocabulary: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Classes:
    """Tokens in classes, numbered in the order in which the classes came about."""

    def __init__(self, tokens: int) -> None:
        self.of = np.full(tokens, -1, dtype=np.int32)
        self.members: list[int] = []

    def new(self) -> int:
        self.members.append(0)
        return len(self.members) - 1

    def join(self, token: int, cls: int) -> None:
        self.of[token] = cls
        self.members[cls] += 1

    def alone(self, token: int) -> tuple[int, int] | None:
        """Gives the token a class of its own; (old, new) if that is a copy of a shared one."""
        old = int(self.of[token])
        if self.members[old] == 1:
            return None
        self.members[old] -= 1
        cls = self.new()
        self.join(token, cls)
        return old, cls


class Automaton:
    """The compiled table. ``labels``: bytes of each token; ``merges``: (a, b, c) by priority; other tokens are bytes."""

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]]) -> None:
        self.labels = labels
        made = {c for _, _, c in merges}
        if len(made) != len(merges):
            raise ValueError("a token is made by more than one merge")
        base = [t for t, label in enumerate(labels) if t not in made and len(label) == 1]
        size = self._classes(base, merges, None)
        self.table = np.zeros((size[0], (size[1] + 7) // 8), dtype=np.uint8)
        self._classes(base, merges, self.table)
        self._compress()
        self._spell(base, made)

    def _classes(self, base: list[int], merges: list[tuple[int, int, int]], table: np.ndarray | None) -> tuple[int, int]:
        """Adds the gadgets one by one; without a table it only counts the classes."""
        rows, columns = Classes(len(self.labels) + 1), Classes(len(self.labels))
        start = len(self.labels)  # the state before the first token
        row, column = rows.new(), columns.new()
        for t in base:
            rows.join(t, row)
            columns.join(t, column)
        rows.join(start, row)
        if table is not None:
            table[row, 0] = 1

        def copy_row(token: int) -> None:
            if (split := rows.alone(token)) and table is not None:
                table[split[1]] = table[split[0]]

        def copy_column(token: int) -> None:
            if (split := columns.alone(token)) and table is not None:
                old, new = split
                table[:, new >> 3] |= ((table[:, old >> 3] >> (old & 7)) & 1) << (new & 7)

        def clear(a: int, b: int) -> None:
            if table is not None:
                j = int(columns.of[b])
                table[rows.of[a], j >> 3] &= 0xFF ^ (1 << (j & 7))

        for a, b, c in merges:
            if table is not None:
                j = int(columns.of[b])
                if not table[rows.of[a], j >> 3] >> (j & 7) & 1:
                    raise ValueError(f"merge {c} never applies")
            rows.join(c, int(rows.of[b]))
            columns.join(c, int(columns.of[a]))
            copy_row(a)
            copy_column(b)
            clear(a, b)
            if a == b:  # three in a row merge from the left: a may not stand before its double
                copy_column(c)
                clear(a, c)
        self.rows, self.columns, self.start = rows.of, columns.of, start
        return len(rows.members), len(columns.members)

    def _compress(self) -> None:
        """Joins classes that came out alike."""
        used = np.unique(self.rows[self.rows >= 0])
        kept, at = np.unique(self.table[used], axis=0, return_inverse=True)
        place = np.full(len(self.table), -1, np.int32)
        place[used] = at.reshape(-1)
        self.rows = np.where(self.rows >= 0, place[self.rows], -1)
        bits = np.packbits(np.unpackbits(kept, axis=1, bitorder="little").T, axis=1, bitorder="little")
        used = np.unique(self.columns[self.columns >= 0])
        kept, at = np.unique(bits[used], axis=0, return_inverse=True)
        place = np.full(len(bits), -1, np.int32)
        place[used] = at.reshape(-1)
        self.columns = np.where(self.columns >= 0, place[self.columns], -1)
        self.table = kept  # by class of the arc, a bit for each state

    def _spell(self, base: list[int], made: set[int]) -> None:
        """The arcs' labels as byte transitions: nodes are beginnings of labels, the longest that the bytes read so far end in.

        ``goto`` maps a node and a byte to the next node, ``ends`` a node to the arcs whose labels end there, longest
        first: (length of the label, place of the arc's class in the table, the state behind it as a byte and its bit, token). Transitions
        that leave the labels are entered when first met.
        """
        self.goto: dict[int, int] = {}
        self.fail, own = [0], [None]
        for t in chain(base, made):
            node = 0
            for byte in self.labels[t]:
                step = node << 8 | byte
                if step not in self.goto:
                    self.goto[step] = len(own)
                    own.append(None)
                    self.fail.append(0)
                node = self.goto[step]
            own[node] = t
        rows, columns, stride = self.rows.tolist(), self.columns.tolist(), self.table.shape[1]
        state = [(r >> 3, 1 << (r & 7)) for r in range(max(rows) + 1)]
        self.first = state[rows[self.start]]
        self.ends: list[tuple] = [()] * len(own)
        below: dict[int, list[tuple[int, int]]] = {}
        for step, child in self.goto.items():
            below.setdefault(step >> 8, []).append((step & 255, child))
        level = [0]
        depth = 0
        while level:  # failure links by depth: those of shorter beginnings are known
            depth += 1
            deeper = []
            for node in level:
                for byte, child in below.get(node, ()):
                    fail = self.step(self.fail[node], byte) if node else 0
                    self.fail[child] = fail
                    t = own[child]
                    self.ends[child] = ((depth, columns[t] * stride, state[rows[t]], t), *self.ends[fail]) if t is not None else self.ends[fail]
                    deeper.append(child)
            level = deeper
        self.flat = self.table.tobytes()
        del self.table

    def step(self, node: int, byte: int) -> int:
        """The node after one more byte."""
        found = self.goto.get(node << 8 | byte)
        if found is None:
            found = self.goto[node << 8 | byte] = self.step(self.fail[node], byte) if node else 0
        return found

    def encode_word(self, word: bytes) -> list[int]:
        """The token sequence that the automaton accepts for these bytes, found from left to right without going back.

        Every prefix has one accepted sequence, so one of the arcs that end at a position may follow the state of the position
        where it starts: its bit is set in the table. That is the position's state, and its token leads back from the end.
        """
        flat, ends, goto = self.flat, self.ends, self.goto
        states, arcs, node = [self.first], [], 0
        for byte in word:
            try:
                node = goto[node << 8 | byte]
            except KeyError:
                node = self.step(node, byte)
            for arc in ends[node]:
                at, bit = states[-arc[0]]
                if flat[arc[1] + at] & bit:
                    break
            else:
                raise ValueError(f"no token holds byte {byte}")
            states.append(arc[2])
            arcs.append(arc)
        out: list[int] = []
        at = len(word)
        while at:
            arc = arcs[at - 1]
            out.append(arc[3])
            at -= arc[0]
        out.reverse()
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids))


class Words(dict):
    """Encoded words met last: (ids as text, ids, decoded bytes)."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton
        self.names = list(map(str, range(len(automaton.labels))))

    def __reduce__(self):
        return Words, (self.automaton,)

    def __missing__(self, word: str) -> tuple[str, list[int], bytes]:
        ids = self.automaton.encode_word(word.encode("utf-8", "surrogatepass"))
        found = (",".join([self.names[i] for i in ids]), ids, self.automaton.decode(ids))
        if len(word) <= CACHE_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = found
        return found


class Tokenizer:
    """A byte-level BPE tokenizer file, without its post-processing, truncation and padding."""

    def __init__(self, spec: dict) -> None:
        model, alphabet = spec["model"], byte_alphabet()
        kind = spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without a normalizer or prefix space is compiled")
        if model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            raise ValueError("an option of this model isn't compiled")
        vocab = model["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens that strip or stand alone aren't compiled")
        labels = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in vocab.items():
            if token not in special:
                labels[i] = bytes(alphabet[ch] for ch in token)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.automaton = Automaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        for content, i in special.items():
            labels[i] = content.encode()
        self.special = {content: (str(i), [i], content.encode()) for content, i in special.items()}
        self.between = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pattern = regex.compile(PATTERN)
        self.split = self.pattern.findall
        self.words = Words(self.automaton)

    def pieces(self, text: str) -> list[tuple[str, list[int], bytes]]:
        """(ids as text, ids, decoded bytes) of each pre-split word and special token of the whole text."""
        if self.between is None or not any(s in text for s in self.special):
            return list(map(self.words.__getitem__, self.split(text)))
        out = []
        for part in self.between.split(text):
            if part in self.special:
                out.append(self.special[part])
            else:
                out.extend(map(self.words.__getitem__, self.split(part)))
        return out

    def blocks(self, text: str) -> Iterator[list[tuple[str, list[int], bytes]]]:
        """The same in lists of whole words, so that a very long text is never one list."""
        if len(text) <= LONG:
            if text:
                yield self.pieces(text)
            return
        for part in self.between.split(text) if self.between else [text]:
            if part in self.special:
                yield [self.special[part]]
                continue
            words = (m.group() for m in self.pattern.finditer(part))
            while block := list(map(self.words.__getitem__, islice(words, LONG // 8))):
                yield block

    def encode(self, text: str) -> list[int]:
        return [i for block in self.blocks(text) for p in block for i in p[1]]

    def decode(self, ids: list[int]) -> str:
        return self.automaton.decode(ids).decode("utf-8", "replace")


@cache
def tokenizer(spec: str) -> Tokenizer:
    """Compiled once in a process."""
    return Tokenizer(json.loads(spec))


def read_spec(spark: SparkSession, path: str) -> str:
    """The tokenizer file's text, read on the driver: its size is that of a vocabulary, whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        return f.read()


class Packed:
    """A pickled object that comes out as the object itself where it is unpickled."""

    def __init__(self, data: bytes) -> None:
        self.data = data

    def __reduce__(self):
        return pickle.loads, (self.data,)


def _compile_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [pickle.dumps(tokenizer(spec)) for spec in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["tokenizer"])


_compiled: dict[str, Packed] = {}


def compiled(spark: SparkSession, spec: str) -> Packed:
    """The tables of a tokenizer file: compiled by one task, as that takes some 300 MB, and held packed here, about 23 MB by the vocabulary."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _compiled:
        one = spark.createDataFrame([(spec,)], "spec string").mapInArrow(_compile_batches, "tokenizer binary")
        _compiled[key] = Packed(bytes(one.first()["tokenizer"]))
    return _compiled[key]


def _encode_batches(sent, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: Tokenizer = sent.value
        for batch in batches:
            counts, coded, decoded, ids = [], [], [], []
            for text in batch.column(1).to_pylist():
                n, as_text, back, mine = 0, hashlib.sha256(), hashlib.sha256(), []
                for found in made.blocks(text or ""):
                    as_text.update((("," if n else "") + ",".join([p[0] for p in found])).encode())
                    n += sum([len(p[1]) for p in found])
                    back.update(b"".join([p[2] for p in found]).decode("utf-8", "replace").encode())
                    if with_ids:
                        mine.append(np.fromiter(chain.from_iterable([p[1] for p in found]), np.int32))
                counts.append(n)
                coded.append(as_text.hexdigest())
                decoded.append(back.hexdigest())
                ids.append(np.concatenate(mine) if mine else np.zeros(0, np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                columns, names = [*columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else ends[:0]))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode_documents(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) and, unless switched off, ids array<int>, for every row.

    The whole text is encoded, and decoded again from the ids. Defined cases: null and empty texts have no
    tokens; special tokens in a text are those tokens; repeated rows each come back; a null doc_id stays
    null; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    made = spark.sparkContext.broadcast(compiled(spark, read_spec(spark, path)))
    thin = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return thin.mapInArrow(_encode_batches(made, with_ids), schema)
