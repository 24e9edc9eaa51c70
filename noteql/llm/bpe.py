"""BPE encoding and decoding with a tokenization automaton compiled from the merges.

The automaton over tokens has a state for every token and a first one, which allows every byte: after token ``t`` it is
in state ``t``, whatever came before. A merge ``u v -> w`` applies one gadget: state ``u`` is replaced by a copy of it
without its arc ``v``, and an arc ``w`` is laid beside every arc ``u`` whose target had an arc ``v``, to where that arc
led, which is the state ``v`` as it was then. The token sequences the finished automaton accepts are exactly the BPE
tokenizations, one for each string. So a state is what its own merges took from the state of its right part at its
birth, and is kept as those arcs alone.

Its arcs spelled out in bytes, the automaton is made deterministic by the subset construction: a state of the byte table
is the token that ends at this byte and the set of arcs under way, each with the state it left and its place among
the tokens' spellings. Exactly one arc under way ends at every byte, as every string has one tokenization. The table's
entries are made when they are first stepped on, as in any lazy subset construction, and stay.

Encoding cuts texts into words as the vocabulary's pre-tokenizer does and steps through the table, one entry a byte; the
tokens that end at the last byte, where that token began, and so on are the word's. The distinct words of some texts step
side by side, so an entry that many of them need is looked up once. Decoding emits the arc labels, the tokens' bytes.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, text_bytes

#: White space as Unicode defines it (the ``regex`` module also counts U+001C to U+001F).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The byte-level pre-tokenizer's word pattern.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Bytes of texts that are encoded together (or one text), and bytes of words that step side by side; longer words
#: step by themselves.
SLICE, ABREAST, LONG = 1 << 22, 1 << 17, 64
#: States of the byte table that are kept. Others are made for a word and dropped after it, and when that has been done
#: for so many states that the kept ones must be of other words, the table is begun anew. Both cost time alone.
TABLE_STATES, DROPPED_STATES = 200_000, 800_000
START = -1


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable ones themselves, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Automaton:
    """The compiled merges of one vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int] | None = None):
        letters = byte_letters()
        self.label: dict[int, bytes] = {i: bytes(letters[c] for c in s) for s, i in vocab.items()}
        self.added = added or {}
        self.label |= {i: s.encode() for s, i in self.added.items()}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.born: dict[int, int] = {}
        self.states: set[int] = {START, *(i for i in vocab.values() if len(self.label[i]) == 1)}
        #: Arcs taken from a state, with the number of the merge that took them.
        self.taken: dict[int, dict[int, int]] = {}
        for number, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if w in self.states:
                raise ValueError(f"merge {number} makes a token that is there already")
            if u not in self.states or v not in self.states or not self.has_arc(u, v):
                continue  # earlier merges keep these two from meeting, so no text has this token
            self.left[w], self.right[w], self.born[w] = u, v, number
            self.taken.setdefault(u, {})[v] = number
            self.states.add(w)
        # The tokens' spellings: where each byte leads from a place, and the token that ends there.
        self.spelled: list[dict[int, int]] = [{}]
        self.ends: dict[int, int] = {}
        for token in self.states - {START}:
            at = 0
            for byte in self.label[token]:
                if byte not in self.spelled[at]:
                    self.spelled[at][byte] = len(self.spelled)
                    self.spelled.append({})
                at = self.spelled[at][byte]
            self.ends[at] = token
        self.length = {token: len(self.label[token]) for token in self.states - {START}}
        most = max(self.label, default=-1) + 1
        self.lengths = np.array([self.length.get(i, 0) for i in range(most)], np.int64)
        self.labels = pa.array([self.label.get(i) for i in range(most)], pa.binary())
        self.decimals = pa.array(map(str, range(most)), pa.string())
        self._begin_table()

    @classmethod
    def load(cls, path: str) -> Automaton:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        return cls(model["vocab"], merges, {x["content"]: x["id"] for x in spec.get("added_tokens") or []})

    def has_arc(self, state: int, token: int) -> bool:
        """Whether ``token`` may follow in ``state``."""
        before = 1 << 60
        while True:
            # No merge after ``before`` counts; of the others, none may have taken the arc since it was laid.
            born = self.born.get(token, -1)
            at: int | None = state
            until = before
            while at is not None:
                gone = self.taken[at].get(token) if at in self.taken else None
                if gone is not None and born < gone <= until:
                    return False
                until = min(until, self.born.get(at, 0) - 1)
                at = self.right.get(at)
            if born < 0:
                return True
            # The arc was laid by its merge where the left part had one.
            token, before = self.left[token], born

    def _begin_table(self) -> None:
        self.table: list[dict[int, int]] = [{}]
        self.token: list[int] = [START]
        #: Of each state the arcs under way, place * 2^32 + state left + 1.
        self.under_way: list[tuple[int, ...]] = [()]
        self.numbers: dict[tuple, int] = {}
        #: Entries made since the table was full: state, byte, and the key of a state that is new.
        self.passing: list[tuple[int, int, tuple | None]] = []
        self.dropped = 0

    def _drop(self) -> None:
        """Take the entries made since the table was full out again."""
        for number, byte, key in self.passing:
            if number < TABLE_STATES:
                self.table[number].pop(byte, None)
            if key is not None:
                del self.numbers[key]
                self.dropped += 1
        for of_states in (self.table, self.token, self.under_way):
            del of_states[TABLE_STATES:]
        self.passing.clear()
        if self.dropped > DROPPED_STATES:
            self._begin_table()

    def _step(self, number: int, byte: int) -> int:
        """Make the table's entry for a state and a byte."""
        moved, ended = [], None
        for arc in (*self.under_way[number], self.token[number] + 1):
            state = (arc & 0xFFFFFFFF) - 1
            place = self.spelled[arc >> 32].get(byte)
            if place is None:
                continue
            token = self.ends.get(place)
            if token is not None and ended is None and self.has_arc(state, token):
                ended = token
            if self.spelled[place]:
                moved.append(place << 32 | state + 1)
        if ended is None:
            raise ValueError("a byte is not in the vocabulary")
        key = (ended, tuple(moved))
        found = self.numbers.get(key)
        new = found is None
        if new:
            found = self.numbers[key] = len(self.table)
            self.table.append({})
            self.token.append(ended)
            self.under_way.append(key[1])
        self.table[number][byte] = found
        if found >= TABLE_STATES or number >= TABLE_STATES:
            self.passing.append((number, byte, key if new else None))
        return found

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """The one accepted path that spells ``word``."""
        table, at, states = self.table, 0, []
        for byte in word:
            to = table[at].get(byte)
            at = self._step(at, byte) if to is None else to
            states.append(at)
        path, end, token, length = [], len(word), self.token, self.length
        while end:
            t = token[states[end - 1]]
            path.append(t)
            end -= length[t]
        if self.passing:
            self._drop()
        return tuple(reversed(path))

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The accepted paths of many words, one after another, and how many tokens each has."""
        paths, counts, at = [], [], 0
        while at < len(words):
            end, size = at, 0
            while end < len(words) and len(words[end]) <= LONG and size < ABREAST:
                size += len(words[end])
                end += 1
            if end > at:
                path, count = self._abreast(words[at:end])
            else:
                end, path = at + 1, np.array(self.encode_word(words[at]), np.int32)
                count = np.array([len(path)])
            paths.append(path)
            counts.append(count)
            at = end
        return (np.concatenate(paths), np.concatenate(counts)) if paths else (np.empty(0, np.int32), np.empty(0, np.int64))

    def _abreast(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        table, token = self.table, self.token
        size = np.array([len(w) for w in words])
        order = np.argsort(-size, kind="stable")
        left = size[order]  # longest first, so that the words that reach a place are the first ones
        begin = (np.cumsum(size) - size)[order]
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        reach = np.searchsorted(-left, -np.arange(left[0]), side="left")
        at, ended = np.zeros(len(words), np.int64), []
        for place, n in enumerate(reach.tolist()):
            keys, which = np.unique(at[:n] << 8 | data[begin[:n] + place], return_inverse=True)
            to = [table[k >> 8].get(k & 255) or self._step(k >> 8, k & 255) for k in keys.tolist()]
            at = np.array(to)[which]
            ended.append(np.array([token[t] for t in to], np.int32)[which])
        ended, row = np.concatenate([*ended, np.empty(0, np.int32)]), np.cumsum(reach) - reach
        rows, count, found = np.flatnonzero(left), np.zeros(len(words), np.int64), []
        while len(rows):  # from the last token to the first
            t = ended[row[left[rows] - 1] + rows]
            found.append((rows, t))
            count[rows] += 1
            left[rows] -= self.lengths[t]
            rows = rows[left[rows] > 0]
        counts = np.empty_like(count)
        counts[order] = count
        last = np.cumsum(counts)[order] - 1
        path = np.empty(count.sum(), np.int32)
        for k, (rows, t) in enumerate(found):
            path[last[rows] - k] = t
        if self.passing:
            self._drop()
        return path, counts

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """``decode`` of many lists of ids, one after another, each with its end."""
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.labels.take(pa.array(ids)))
        return [x.decode("utf-8", "replace").encode() for x in pc.binary_join(listed, pa.scalar(b"", pa.binary())).to_pylist()]

    def decode(self, ids) -> bytes:
        """The labels of ``ids``, as text in UTF-8: bytes that are no text become U+FFFD."""
        data = b"".join(map(self.label.__getitem__, ids))
        return data.decode("utf-8", "replace").encode()


def _ragged(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each of some stretches, ``count`` each."""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _expand(which: np.ndarray, values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``which`` its stretch of ``values``, and how many that are; ``counts`` are those of the stretches."""
    many = counts[which]
    return values[_ragged((np.cumsum(counts) - counts)[which], many)], many


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sums of stretches of ``values``."""
    return np.diff(np.append(0, np.cumsum(values))[np.append(0, np.cumsum(counts))])


class Encoder:
    """Cuts texts into words and encodes each distinct word of a slice of texts once.

    No word goes on across a space, and a space between two characters that are no white space belongs to the word after
    it. So what stands between such spaces is cut into words once, whatever is around it."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.find = regex.compile(PATTERN).findall
        self.wide = regex.compile(f" [{SPACE}]|[{SPACE}] |^ | $").search
        added = sorted(automaton.added, key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None

    def forget(self) -> None:
        """Give the table back: a worker lives on after its tasks, beside those of other stages."""
        self.automaton._begin_table()

    def _pieces(self, text: str):
        """The words of a text, and for added tokens their ids."""
        for part in self.added.split(text) if self.added is not None else [text]:
            if part in self.automaton.added:
                yield self.automaton.added[part]
            else:
                yield from self.find(part)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one after another, and how many each has."""
        odd = [not t or self.wide(t) is not None or any(a in t for a in self.automaton.added) for t in texts]
        runs = pc.split_pattern(pa.array([t for t, o in zip(texts, odd) if not o], pa.large_string()), " ")
        n_runs = pc.list_value_length(runs).to_numpy().astype(np.int64)
        runs = runs.flatten()
        # A text's first run has no space before it.
        heads = np.cumsum(n_runs) - n_runs
        inner = np.ones(len(runs), bool)
        inner[heads] = False
        rest, firsts = runs.filter(pa.array(inner)).dictionary_encode(), runs.take(pa.array(heads)).dictionary_encode()
        known = rest.dictionary.to_pylist()
        units = np.empty(len(runs), np.int64)
        units[inner], units[heads] = rest.indices.to_numpy(), len(known) + firsts.indices.to_numpy().astype(np.int64)
        words = self.find(" " + " ".join(known)) if known else []
        begun = np.flatnonzero([w[0] == " " for w in words])
        n_words = [np.diff(np.append(begun, len(words)))]
        for first in firsts.dictionary.to_pylist():
            mine = self.find(first)
            words += mine
            n_words.append([len(mine)])
        # Of the other texts every piece is a unit of its own.
        others: dict[str | int, int] = {}
        listed = [[others.setdefault(x, len(others)) for x in self._pieces(t)] for t, o in zip(texts, odd) if o]
        more = np.array([x for one in listed for x in one], np.int64) + len(known) + len(firsts.dictionary)
        words += [x if isinstance(x, str) else "" for x in others]
        n_words.append(np.ones(len(others), np.int64))
        distinct = pa.array(words, pa.large_string()).dictionary_encode()
        path, counts = self.automaton.encode_words(distinct.dictionary.cast(pa.large_binary()).to_pylist())
        n_words = np.concatenate(n_words).astype(np.int64)
        ids, n_ids = _expand(distinct.indices.to_numpy(), path, counts)
        n_ids = _sums(n_ids, n_words)
        tokens = [x for x in others if not isinstance(x, str)]
        if tokens:  # an added token is a unit whose word is empty
            empty = len(n_ids) - len(others) + np.flatnonzero([not isinstance(x, str) for x in others])
            ids = np.insert(ids, np.cumsum(n_ids)[empty], tokens)
            n_ids[empty] = 1
        # The units of each text, in the texts' order.
        many = np.empty(len(texts), np.int64)
        is_odd = np.array(odd, bool)
        many[~is_odd], many[is_odd] = n_runs, [len(one) for one in listed]
        begin = np.empty(len(texts), np.int64)
        begin[~is_odd], begin[is_odd] = heads, len(units) + np.cumsum(many[is_odd]) - many[is_odd]
        ids, of_unit = _expand(np.concatenate([units, more])[_ragged(begin, many)], ids, n_ids)
        return ids, _sums(of_unit, many)

    def slices(self, column):
        """(rows, ids, ends): the rows of an Arrow column of texts in slices, their ids one after another, and where those
        of each end, beginning with 0."""
        texts = text_bytes(column)
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE):
                size += len(texts[end])
                end += 1
            ids, many = self.encode([t.decode() for t in texts[at:end]])
            yield slice(at, end), ids, np.append(0, np.cumsum(many))
            at = end


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker; it is compiled again wherever a worker is lost."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(Automaton.load(path))
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _listed(ids: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, vocabulary: str | None = None, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id and ids (array of int) for each row; a null or empty text has no ids. Repeated rows stay apart."""
    path = vocabulary or default_path()

    def run(batches):
        enc = encoder(path)
        for b in batches:
            for rows, ids, ends in enc.slices(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0)[rows], _listed(ids, ends)], ["doc_id", "ids"])
        enc.forget()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, vocabulary: str | None = None, id_col="doc_id", ids_col="ids") -> DataFrame:
    """doc_id and text for each row of ids; null ids count as none."""
    path = vocabulary or default_path()

    def run(batches):
        automaton = encoder(path).automaton
        for b in batches:
            texts = [automaton.decode(ids or ()).decode() for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, vocabulary: str | None = None, id_col="doc_id", text_col="text", with_ids: bool = False) -> DataFrame:
    """Both ways in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if asked for, for each row."""
    path = vocabulary or default_path()

    def run(batches):
        enc = encoder(path)
        a, sha = enc.automaton, hashlib.sha256
        for b in batches:
            for rows, ids, ends in enc.slices(b.column(1)):
                shown = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), a.decimals.take(pa.array(ids)))
                listed = pc.binary_join(shown, ",").cast(pa.binary()).to_pylist()
                digest = lambda texts: pa.array([sha(x).hexdigest() for x in texts], pa.string())
                made = [b.column(0)[rows], pa.array(np.diff(ends), pa.int64()), digest(listed), digest(a.decode_all(ids, ends))]
                yield pa.RecordBatch.from_arrays(made + [_listed(ids, ends)] * with_ids, names)
        enc.forget()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
