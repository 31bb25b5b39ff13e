"""Byte-pair encoding and decoding: distinct words in a trie, last-token states passed down depth first."""

from __future__ import annotations

import gc
import json
import struct
from collections.abc import Iterable, Iterator
from itertools import chain
from os.path import commonprefix

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import pieces

#: Words that a Python worker keeps with their encodings: two generations of this many, the older one only for what is used again.
CACHE_WORDS = 100_000
#: Pairs of tokens whose fit is kept.
KNOWN_PAIRS = 200_000
# The normaliser and the word split that this encoder follows; a file with others is refused.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def _byte_chars() -> list[str]:
    """The printable character for each byte that byte-level vocabularies use: itself where it prints, else from 256 on."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


BYTE_CHARS = _byte_chars()
#: First characters of words that are in byte characters already, and of special tokens; other words have none beyond U+024F.
_MAPPED, _SPECIAL = "\ue000", "\ue001"
#: Ends each word in the trie; byte characters don't include it.
_END = "\0"


class WordEncoder:
    """Encodes words (as byte characters) by a vocabulary with ranked merges and an end-of-word suffix.

    The encoding of a prefix ends in one certain token, and a word's encoding is the encoding of a prefix and that
    token. So the state of a prefix is its last token and where it starts. A token can follow another exactly if
    merging the characters of both would not have merged across the border: merges happen by rank, so a piece at the
    end of the first and a piece at the start of the second must not have a merge that comes before the merges which
    took these pieces into their own tokens (of equal ranks, the one further left comes first).
    """

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str):
        self.vocab, self.suffix = vocab, suffix
        self.rank = {tuple(m): k for k, m in enumerate(merges)}
        self.never = len(self.rank)
        self.longest = max(map(len, vocab))
        self.known: dict[tuple[str, str], bool] = {}
        self.pieces: dict[str, tuple | None] = {"": None}

    def _pieces(self, token: str) -> tuple | None:
        """The pieces at a token's start and at its end as its merges build it, each with the rank of the merge that
        takes it in; None if merging its characters gives no single token."""
        core = token.removesuffix(self.suffix) or token
        parts = [(c, (), ()) for c in core]
        if core != token:
            parts[-1] = (core[-1] + self.suffix, (), ())
        while len(parts) > 1:
            rank, k = min((self.rank.get((x[0], y[0]), self.never), k) for k, (x, y) in enumerate(zip(parts, parts[1:])))
            if rank == self.never:
                return None
            x, y = parts[k], parts[k + 1]
            parts[k : k + 2] = [(x[0] + y[0], (*x[1], (x[0], rank)), (*y[2], (y[0], rank)))]
        whole = ((token, self.never),)
        return parts[0][1] + whole, parts[0][2] + whole

    def _follows(self, before: str, token: str) -> bool:
        key = (before, token)
        if (ok := self.known.get(key)) is None:
            if len(self.known) > KNOWN_PAIRS:
                self.known.clear()
            for t in key:
                if t not in self.pieces:
                    self.pieces[t] = self._pieces(t)
            first, last = self.pieces[token], self.pieces[before]
            rank = self.rank.get
            ok = self.known[key] = first is not None and (last is None or not any((r := rank((a, b))) is not None and r < till_a and r <= till_b for a, till_a in last[1] for b, till_b in first[0]))
        return ok

    @staticmethod
    def _insert(root: dict, word: str) -> None:
        """A trie whose edges carry strings: {first character: [string, further edges or None, word]}; words end in _END."""
        key, node, at = word + _END, root, 0
        while (edge := node.get(key[at])) is not None:
            label, same = edge[0], 1
            most = min(len(label), len(key) - at)
            while same < most and label[same] == key[at + same]:
                same += 1
            if same < len(label):  # the edge forks here
                edge[:] = [label[:same], {label[same]: [label[same:], *edge[1:]]}, None]
            node, at = edge[1], at + same
        node[key[at]] = [key[at:], None, word]

    def _step(self, text: str, skipped: int, depth: int, states: list[tuple[str, int]], end: str) -> tuple[str, int]:
        """The state of the prefix of `depth` characters from the states of the shorter ones; text is the word without its
        first `skipped` characters. Only one token can end a prefix, so the likely ones go first: the last one,
        grown, then short ones."""
        vocab, known = self.vocab, self.known
        last, grown = states[depth - 1]
        token = last + text[depth - 1 - skipped] + end
        if token in vocab:
            before = states[grown][0]
            if (ok := known.get((before, token))) or ok is None and self._follows(before, token):
                return token, grown
        for start in range(depth - 1, max(0, depth - self.longest) - 1, -1):
            token = text[start - skipped : depth - skipped] + end
            if token in vocab and start != grown:
                before = states[start][0]
                if (ok := known.get((before, token))) or ok is None and self._follows(before, token):
                    return token, start
        raise ValueError(f"no token ends {text[: depth - skipped]!r}")

    def _tokens(self, last: tuple[str, int], states: list[tuple[str, int]]) -> list[str]:
        out = [last[0]]
        while last[1]:
            last = states[last[1]]
            out.append(last[0])
        return out[::-1]

    def encode(self, words: Iterable[str]) -> dict[str, list[str]]:
        """Tokens of each word, whatever its length. The words are put into a trie, whose prefixes are visited depth
        first, each once; only the end of a path that a token may cover is carried along."""
        out: dict[str, list[str]] = {}
        root: dict = {}
        for word in words:
            self._insert(root, word)
        states: list[tuple[str, int]] = [("", 0)]
        todo = [(edge, 0, "") for edge in root.values()]
        while todo:
            (label, below, word), depth, tail = todo.pop()
            del states[depth + 1 :]
            text, skipped = tail + label, depth - len(tail)
            if label == _END:  # the state of this prefix as a whole word; states has the one for longer words
                out[word] = self._tokens(self._step(text, skipped, depth, states, self.suffix), states)
                continue
            for k in range(len(label) - (below is None)):
                depth += 1
                if below is None and k == len(label) - 2:
                    out[word] = self._tokens(self._step(text, skipped, depth, states, self.suffix), states)
                else:
                    states.append(self._step(text, skipped, depth, states, ""))
            if below is not None:
                todo += [(edge, depth, text[-self.longest :]) for edge in below.values()]
        return out


class TextEncoder:
    """Encodes and decodes texts as a tokenizer file of the `tokenizers` library says: its normaliser and word split
    (here for texts of Latin characters, by the library itself for all others), then WordEncoder on distinct words."""

    def __init__(self, definition: str):
        self.definition = definition
        d = json.loads(definition)
        model = d["model"]
        plain_model = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")) and model["end_of_word_suffix"]
        plain_tokens = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in d["added_tokens"])
        if d["normalizer"] != NORMALIZER or d["pre_tokenizer"] != PRE_TOKENIZER or d["decoder"] or not plain_model or not plain_tokens:
            raise ValueError("a tokenizer file of another kind: normaliser, word split, decoder, model or added tokens differ")
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.words = WordEncoder(model["vocab"], [tuple(m) for m in merges], model["end_of_word_suffix"])
        self.packed_id = {t: struct.pack("<I", k) for t, k in model["vocab"].items()}
        self.ids: dict[str, bytes] = {}
        self.decoded: dict[str, str] = {}
        self.old: tuple[dict[str, bytes], dict[str, str]] = ({}, {})
        self.plain = regex.compile(r"[\u0000-ɏ]*+")
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x85\xA0\p{L}\p{N}]+")
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.special_start = commonprefix(list(self.special))
        self._library = None

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.definition)
        return self._library

    def _split_plain(self, text: str) -> list[str]:
        """Words as byte characters; for ASCII letters that is the word itself."""
        if self.plain.fullmatch(text):
            return self.split.findall(text.lower())
        normal = self.library.normalizer.normalize_str(text)
        return [_MAPPED + w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def split_text(self, text: str) -> list[str]:
        if self.at_special is None or self.special_start not in text:
            return self._split_plain(text)
        parts = self.at_special.split(text)
        return list(chain.from_iterable([_SPECIAL + p] if k % 2 else self._split_plain(p) for k, p in enumerate(parts) if p))

    def learn(self, new: set[str]) -> None:
        """Encodes words that the cache lacks."""
        own: dict[str, list[str]] = {}
        old_ids, old_decoded = self.old
        for w in new:
            if w in old_ids:
                self.ids[w], self.decoded[w] = old_ids[w], old_decoded[w]
            elif w[0] == _SPECIAL:
                self.ids[w], self.decoded[w] = struct.pack("<I", self.special[w[1:]]), w[1:]
            else:
                chars = w[1:] if w[0] == _MAPPED else w if w.isascii() and w.isprintable() else "".join([BYTE_CHARS[b] for b in w.encode()])
                own.setdefault(chars, []).append(w)
        packed_id = self.packed_id.__getitem__
        for chars, tokens in self.words.encode(own).items():
            packed, text = b"".join(map(packed_id, tokens)), " ".join(tokens)
            for w in own[chars]:
                self.ids[w], self.decoded[w] = packed, text

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """(ids as little-endian 32-bit numbers, decoded text) of each text; decoding joins the tokens of the ids by spaces."""
        if len(self.ids) > CACHE_WORDS:
            self.old, self.ids, self.decoded = (self.ids, self.decoded), {}, {}
        split = [self.split_text(t) for t in texts]
        self.learn(set(chain.from_iterable(split)) - self.ids.keys())
        return [b"".join(map(self.ids.__getitem__, x)) for x in split], [" ".join(map(self.decoded.__getitem__, x)) for x in split]


def encode_texts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ids (binary: little-endian unsigned 32-bit numbers), n_tokens, decoded.

    The same ids as the `tokenizers` library gives for the file without special tokens added, and the same text as it
    decodes them to with special tokens kept. Only a map over the texts: nothing is shuffled, and a lost task is
    repeated alone. The file goes to the tasks by broadcast (a few MB). A null or empty text has no ids and decodes
    to an empty text; rows that repeat an id are encoded each; an empty table gives an empty result; extra columns are
    ignored. Very long texts and words are encoded whole, one text at a time. A file whose normaliser, word split, model
    or decoder is of another kind than this encoder follows is refused.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(definition.value)
        gc.disable()  # millions of small objects without cycles: counting references frees them
        try:
            for batch in batches:
                for piece, texts in pieces(batch, batch.column("_text"), 2 << 20):
                    ids, decoded = encoder.encode([t or "" for t in texts.to_pylist()])
                    yield pa.RecordBatch.from_arrays([piece.column("_id"), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["_id", "ids", "decoded"])
        finally:
            gc.enable()

    made = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"_id {df.schema[id_col].dataType.simpleString()}, ids binary, decoded string")
    return made.select(F.col("_id").alias(id_col), "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "decoded")
