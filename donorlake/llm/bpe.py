"""Byte-pair encoding and decoding by a prefix-sharing trie.

The encoding of a byte string ends in one *last token*, and what stands before
that token is the encoding of the string without it. So one number per prefix,
its last token, holds the encodings of all prefixes. The distinct words of a
batch are inserted into a trie; a depth-first walk hands every node the last
tokens on its path, tries the vocabulary's tokens that end there, and
keeps the one that may follow the last token of the remaining
prefix. Words that share a prefix share that work. Whether token ``b`` may
follow token ``a`` is a question about the pair alone: joining them must not
let any merge cross their border before both are complete.

Nothing is shuffled: every task encodes its own rows and keeps the encodings of
words seen before in a cache of bounded size. The vocabulary (a file of fixed
size) is read on the driver and broadcast.

Rows: a NULL text is encoded as the empty text (0 tokens); a NULL doc_id stays
NULL; repeated rows give repeated results; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from donorlake.llm.text import Shared, map_rows

# Fixed value: the byte-level pre-tokenisation pattern of this vocabulary.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_WORDS = 200_000  # words whose encodings a task keeps
TRIE_NODES = 1_000_000  # nodes after which a task starts a new trie
LONG_WORD = 256  # bytes; longer words are encoded alone and not kept


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file: Latin-1's visible ones stand for themselves."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass
class Vocabulary:
    tokens: dict[bytes, int]  # reachable tokens only
    text: dict[int, bytes]
    special: dict[str, int]
    merge_rank: dict[tuple[int, int], int]
    left_spine: list  # per token: (piece, rank of the merge that uses it up), from its first byte upwards
    right_spine: list  # the same along its last pieces
    longest: int


def read_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    raw = lambda s: bytes(letters[c] for c in s)
    special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
    names = {s: i for s, i in spec["model"]["vocab"].items() if s not in special}
    text = {i: raw(s) for s, i in names.items()}
    merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    rank, made = {}, {}
    for r, (a, b) in enumerate(merges):
        pair, joined = (names[a], names[b]), names[a + b]
        rank[pair] = r
        made.setdefault(joined, (*pair, r))
    size = max(text) + 1
    left, right = [()] * size, [()] * size
    never = len(merges)
    for i, b in text.items():
        if len(b) == 1:
            left[i] = right[i] = ((i, never),)
    vocab = Vocabulary({text[i]: i for i in text if len(text[i]) == 1}, text | {i: s.encode() for s, i in special.items()}, special, rank, left, right, 1)
    for joined, (a, b, r) in sorted(made.items(), key=lambda x: x[1][2]):  # pieces come before what they form
        left[joined] = (*left[a][:-1], (left[a][-1][0], r), (joined, never))
        right[joined] = (*right[b][:-1], (right[b][-1][0], r), (joined, never))
        if text[a] in vocab.tokens and text[b] in vocab.tokens and _undisturbed(vocab, right[a], left[b], r):
            vocab.tokens[text[joined]] = joined
            vocab.longest = max(vocab.longest, len(text[joined]))
    return vocab


def _undisturbed(vocab: Vocabulary, right, left, until: int) -> bool:
    """Whether no merge of rank below ``until`` crosses the border between a string ending in the pieces ``right`` and
    one starting with ``left``. Lower ranks merge first; of equal ranks the leftmost does."""
    i = j = 0
    while True:
        (a, ra), (b, rb) = right[i], left[j]
        cross = vocab.merge_rank.get((a, b), until)
        if cross < until and cross < ra and cross <= rb:
            return False
        if i + 1 < len(right) and (j + 1 >= len(left) or ra <= rb):
            i += 1
        elif j + 1 < len(left):
            j += 1
        else:
            return True


class Encoder:
    """Encodes words of one task; remembers pairs and (up to a bound) words."""

    def __init__(self, vocab: Vocabulary, limit: int = CACHE_WORDS, max_nodes: int = TRIE_NODES, keep_ids: bool = False):
        self.vocab, self.limit, self.max_nodes, self.keep_ids = vocab, limit, max_nodes, keep_ids
        self.children: dict[int, int] = {}  # (node, byte) to node
        self.node_last = [0]  # last token of the prefix that a node stands for
        self.known: dict[str, tuple[str, bytes, int, bytes]] = {}
        self.pairs: dict[int, bool] = {}
        self.find = regex.compile(WORD_PATTERN).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, vocab.special)) + ")").split if vocab.special else None

    def follows(self, a: int, b: int) -> bool:
        key = a << 32 | b
        got = self.pairs.get(key)
        if got is None:
            v = self.vocab
            if len(self.pairs) > 4_000_000:
                self.pairs.clear()
            got = self.pairs[key] = _undisturbed(v, v.right_spine[a], v.left_spine[b], len(v.merge_rank))
        return got

    def extend(self, word: bytes, path: list[int], last: list[int]) -> None:
        """Walk the trie from the node on top of ``path`` to the end of ``word``, adding the nodes that are missing.

        ``last`` gets the last token of every prefix. Exactly one token is right for a new node, so the short ones,
        which are nearly always right, are tried first.
        """
        children, node_last = self.children, self.node_last
        tokens, pairs, follows, longest = self.vocab.tokens.get, self.pairs, self.follows, self.vocab.longest
        node = path[-1]
        for end in range(len(path), len(word) + 1):
            edge = node << 8 | word[end - 1]
            node = children.get(edge)
            if node is None:
                for start in range(end - 1, max(-1, end - longest - 1), -1):
                    token = tokens(word[start:end])
                    if token is not None:
                        if not start:
                            break
                        key = last[start] << 32 | token
                        good = pairs.get(key)
                        if follows(last[start], token) if good is None else good:
                            break
                node = children[edge] = len(node_last)
                node_last.append(token)
            path.append(node)
            last.append(node_last[node])

    def ids(self, word: bytes, last: list[int]) -> list[int]:
        out, end, text = [], len(word), self.vocab.text
        while end:
            out.append(last[end])
            end -= len(text[last[end]])
        return out[::-1]

    def learn(self, words: set[str]) -> None:
        """Insert new words into the trie in depth-first order.

        Sorted words are the depth-first order of their trie: the stack of nodes and last tokens of the prefix that a
        word shares with the one before it stays as it is, and the walk goes on below.
        """
        if len(self.node_last) > self.max_nodes:
            self.children, self.node_last = {}, [0]
        path, last, before = [0], [0], b""
        for raw, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            shared, most = 0, min(len(before), len(raw))
            while shared < most and before[shared] == raw[shared]:
                shared += 1
            del path[shared + 1 :], last[shared + 1 :]
            self.extend(raw, path, last)
            before = raw
            self.known[word] = self.pack(self.ids(raw, last))

    def pack(self, ids: list[int]) -> tuple[str, bytes, int, bytes]:
        """What a document needs of a word: its ids as text, its decoded bytes, their number, and (if kept) the ids as 32-bit integers."""
        text = self.vocab.text
        return ",".join(map(str, ids)), b"".join([text[i] for i in ids]), len(ids), np.array(ids, np.int32).tobytes() if self.keep_ids else b""

    def long_word(self, word: str) -> tuple[str, bytes, int, bytes]:
        """A word too long to keep is encoded along a trie of its own."""
        raw, last, kept = word.encode("utf-8", "surrogatepass"), [0], (self.children, self.node_last)
        self.children, self.node_last = {}, [0]
        self.extend(raw, [0], last)
        self.children, self.node_last = kept
        return self.pack(self.ids(raw, last))

    def words(self, text: str) -> list[str]:
        """Pre-tokens in order; special tokens stand as themselves."""
        if self.split is None or not any(s in text for s in self.vocab.special):
            return self.find(text)
        out: list[str] = []
        for part in self.split(text):
            out += [part] if part in self.vocab.special else self.find(part)
        return out

    def encode(self, texts: list[str]) -> list[list[tuple[str, bytes, int, bytes]]]:
        split = [self.words(t) for t in texts]
        fresh = {w for words in split for w in words}
        special = {w for w in fresh if w in self.vocab.special}
        long = {w for w in fresh if len(w) > LONG_WORD} - special
        if len(self.known) + len(fresh) > self.limit:
            self.known.clear()
        self.learn({w for w in fresh if w not in self.known} - special - long)
        table = self.known
        if special or long:
            extra = {w: self.pack([self.vocab.special[w]]) for w in special} | {w: self.long_word(w) for w in long}
            return [[extra[w] if w in extra else table[w] for w in words] for words in split]
        return [[table[w] for w in words] for words in split]


def decode_ids(vocab: Vocabulary, ids: list[int]) -> str:
    """Text of token ids; bytes that aren't UTF-8 become replacement characters."""
    return b"".join(vocab.text[i] for i in ids).decode("utf-8", "replace")


def encode(docs: DataFrame, vocabulary: str, keep_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids array<int>`` on demand) of every whole text."""
    shared = Shared(docs.sparkSession, read_vocabulary(vocabulary))
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")

    def work():
        encoder = Encoder(shared.value, keep_ids=keep_ids)

        def each(batch: pa.RecordBatch):
            n, ids_hex, text_hex, ids = [], [], [], []
            for pieces in encoder.encode([t or "" for t in batch.column(1).to_pylist()]):
                listed = ",".join([p[0] for p in pieces])
                back = b"".join([p[1] for p in pieces]).decode("utf-8", "replace")
                n.append(sum([p[2] for p in pieces]))
                ids_hex.append(sha256(listed.encode()).hexdigest())
                text_hex.append(sha256(back.encode()).hexdigest())
                ids += [p[3] for p in pieces] if keep_ids else ()
            out = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hex), pa.array(text_hex)]
            if keep_ids:
                ends = pa.array(np.cumsum([0, *n]), pa.int32())
                out.append(pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), np.int32))))
            return out

        return each

    return map_rows(docs, ["doc_id", "text"], schema, work)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``; special tokens are kept."""
    shared = Shared(encoded.sparkSession, read_vocabulary(vocabulary))

    def work():
        return lambda batch: [batch.column(0), pa.array([decode_ids(shared.value, x or []) for x in batch.column(1).to_pylist()], pa.string())]

    return map_rows(encoded, ["doc_id", "ids"], "doc_id bigint, text string", work)
