"""BPE encoding and decoding over a trie of distinct words.

A BPE encoding is the only cut of a word into tokens in which each two
neighbours would also be neighbours if they were encoded alone. The last token
of a prefix therefore follows from the last tokens of shorter prefixes: it is
the suffix token that fits the last token of what stands before it. Distinct
words, visited in sorted order, are the leaves of their trie in depth-first
order; the stack of (automaton state, last token) along the current path is kept,
so a prefix that many words share is worked out once.

The trie is built a task and a batch at a time, over words the task has not met:
nothing is shuffled, and the memory a task keeps is bounded by ``WORDS_KEPT``.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from marginalia.llm.common import keyed_text, map_batches

#: White space as the tokenizer's patterns see it (the White_Space property).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Separators that str.split() takes as white space and the tokenizer doesn't.
ODD_SPACE = re.compile("[\x1c-\x1f]")
SPLIT_SPACE = re.compile(f"[{SPACE}]+")
#: Beyond these scripts, Unicode versions differ on what is a letter: the library's own normaliser and splitter decide.
UNSETTLED = re.compile("[\u0500-\U0010ffff]")
#: Distinct space-free chunks a task remembers.
WORDS_KEPT = 500_000
#: Texts whose new words make one trie.
TEXTS_AT_ONCE = 2048
PAIRS_KEPT = 1_000_000
#: Steps of the automaton over failing ones that a task remembers.
STEPS_KEPT = 500_000
UNBOUNDED = 1 << 30


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies, turned round: printable bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {chr(b) if b in plain else chr(next(rest)): b for b in range(256)}


class WordTrieBpe:
    """Encoder of single words for a byte-level BPE file with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.vocab.items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names.update({i: t for t, i in self.specials.items()})
        alphabet = byte_alphabet()
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[int, int] = {}
        rank_of: dict[int, int] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            a, b, whole = self.vocab[left], self.vocab[right], self.vocab[left + right]
            self.parts[whole] = (a, b)
            self.merged[a << 20 | b] = whole
            rank_of[whole] = rank
        #: When a token comes into being; single symbols are there from the start.
        self.born = {i: rank_of.get(i, -1) for i in self.vocab.values()}
        self.fits_known: dict[int, bool] = {}
        self._automaton({self._symbols(t, alphabet): i for t, i in self.vocab.items()})

    def _symbols(self, token: str, alphabet: dict[str, int]) -> str:
        """A token as code points below 256, or from 256 on for the symbol that ends a word."""
        ends = bool(self.suffix) and token.endswith(self.suffix) and token != self.suffix
        raw = [alphabet[c] for c in (token[: -len(self.suffix)] if ends else token)]
        if ends:
            raw[-1] += 256
        return "".join(map(chr, raw))

    def _automaton(self, tokens: dict[str, int]) -> None:
        """Aho-Corasick over the vocabulary: for each state, the tokens that end there, longest first."""
        step: dict[int, int] = {}
        own: list[tuple[tuple[int, int], ...]] = [()]
        depth_first: list[list[tuple[int, int, int]]] = []
        for text, i in tokens.items():
            state = 0
            for d, c in enumerate(text):
                key = state << 10 | ord(c)
                if key not in step:
                    step[key] = len(own)
                    own.append(())
                    if d == len(depth_first):
                        depth_first.append([])
                    depth_first[d].append((state, ord(c), step[key]))
                state = step[key]
            own[state] = ((i, len(text)),)
        self.tree, self.step, self.ends = step, dict(step), own
        self.back = [0] * len(own)
        for level in depth_first:
            for parent, c, state in level:
                self.back[state] = self._follow(self.back[parent], c, step) if parent else 0
                own[state] += own[self.back[state]]

    def _follow(self, state: int, c: int, step: dict[int, int]) -> int:
        while True:
            to = step.get(state << 10 | c)
            if to is not None:
                return to
            if not state:
                return 0
            state = self.back[state]

    def fits(self, a: int, b: int) -> bool:
        """Whether the tokens a and b stay apart when a+b is encoded: merges are undone latest first, and no merge
        over the border may come before the merge that consumed either side of it."""
        key = a << 20 | b
        known = self.fits_known.get(key)
        if known is None:
            if len(self.fits_known) > PAIRS_KEPT:
                self.fits_known.clear()
            known = self.fits_known[key] = self._fits(a, b)
        return known

    def _fits(self, a: int, b: int) -> bool:
        born, bound = self.born, UNBOUNDED
        while True:
            over = self.merged.get(a << 20 | b)
            if over is not None and born[over] < bound:
                return False
            if born[a] > born[b]:
                bound, a = born[a], self.parts[a][1]
            elif born[b] >= 0:
                bound, b = born[b] + 1, self.parts[b][0]
            else:
                return True

    def encode_words(self, words) -> dict[str, tuple[int, ...]]:
        """Ids of each distinct, non-empty word."""
        spelled = {}
        for w in words:
            raw = w.encode("utf-8").decode("latin-1")
            spelled[raw[:-1] + chr(256 + ord(raw[-1])) if self.suffix else raw] = w
        out: dict[str, tuple[int, ...]] = {}
        if len(self.step) > len(self.tree) + STEPS_KEPT:
            self.step = dict(self.tree)
        tree, step, ends, fits_known = self.tree, self.step, self.ends, self.fits_known
        longest = max(map(len, spelled), default=0) + 1
        states, tokens, lengths = [0] * longest, [-1] * longest, [0] * longest
        before = ""
        for text in sorted(spelled):
            # how much of the path to the word before this one shares
            n = len(text)
            shared = 0
            for x, y in zip(before, text):
                if x != y:
                    break
                shared += 1
            state = states[shared]
            for i in range(shared, n):
                key = state << 10 | ord(text[i])
                to = step.get(key)
                if to is None:
                    to = self._follow(state, key & 1023, tree)
                    step[key] = to
                state = to
                i += 1
                for token, length in ends[state]:
                    if length == i:
                        break
                    key = tokens[i - length] << 20 | token
                    fit = fits_known.get(key)
                    if fit if fit is not None else self.fits(tokens[i - length], token):
                        break
                else:
                    raise ValueError(f"the vocabulary lacks a symbol of {text!r}")
                states[i], tokens[i], lengths[i] = state, token, length
            ids, at = [], n
            while at:
                ids.append(tokens[at])
                at -= lengths[at]
            ids.reverse()
            out[spelled[text]] = tuple(ids)
            before = text
        return out


class TextCodec:
    """Whole texts to ids and back, as the tokenizer file says, with a bounded memory of chunks."""

    WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str, parse_special: bool = True):
        self.words = WordTrieBpe(path)
        library = Tokenizer.from_file(path)
        self.normaliser, self.splitter, self.alphabet = library.normalizer, library.pre_tokenizer, byte_alphabet()
        self.known: dict[str, tuple[str, str]] = {}
        self.decimal = {i: str(i) for i in self.words.names}
        specials = sorted(self.words.specials, key=len, reverse=True) if parse_special else []
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None

    @staticmethod
    def normalise(text: str) -> str:
        # one code point at a time: str.lower() alone has a rule for a final sigma that looks at its neighbours
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def chunks(self, text: str) -> list[str]:
        if UNSETTLED.search(text):
            cut = self.splitter.pre_tokenize_str(self.normaliser.normalize_str(text))
            return ["\v" + bytes([self.alphabet[c] for c in word]).decode() for word, _ in cut]
        text = self.normalise(text)
        if ODD_SPACE.search(text):
            return [c for c in SPLIT_SPACE.split(text) if c]
        return text.split()

    def pieces(self, text: str) -> list[str]:
        """White-space-free chunks; special tokens after a line feed, and single words after a vertical tab."""
        if self.special is None or not self.special.search(text):
            return self.chunks(text)
        out: list[str] = []
        for i, part in enumerate(self.special.split(text)):
            out += ["\n" + part] if i % 2 else self.chunks(part)
        return out

    def learn(self, texts: list[list[str]]) -> None:
        every = set().union(*texts)
        fresh = every.difference(self.known)
        if len(self.known) + len(fresh) > WORDS_KEPT:
            self.known.clear()
            fresh = every
        # a chunk of letters alone is one word
        split = {c: [c[1:]] if c[0] == "\v" else self.WORD.findall(c) for c in fresh if c[0] != "\n" and not c.isalpha()}
        words = {w for ws in split.values() for w in ws}
        words.update(c for c in fresh if c.isalpha())
        known, decimal, name = self.known, self.decimal, self.words.names
        spelled = {w: known[w] for w in words if w in known}  # a word that stood alone before
        spelled.update((w, (" ".join([decimal[i] for i in x]), " ".join([name[i] for i in x]))) for w, x in self.words.encode_words(words - spelled.keys()).items())
        for c in fresh:
            ws = split.get(c)
            if ws is None:
                known[c] = spelled[c] if c[0] != "\n" else (str(self.words.specials[c[1:]]), c[1:])
            elif len(ws) == 1:
                known[c] = spelled[ws[0]]
            else:
                both = [spelled[w] for w in ws]
                known[c] = (" ".join([b[0] for b in both]), " ".join([b[1] for b in both]))

    def encode(self, texts: list[str]) -> list[tuple[str, str]]:
        """For each text its decimal ids, joined by a space, and the decoded text."""
        cut = [self.pieces(t) for t in texts]
        self.learn(cut)
        of = self.known.__getitem__
        out = []
        for chunks in cut:
            ids, decoded = zip(*map(of, chunks)) if chunks else ((), ())
            out.append((" ".join(ids), " ".join(decoded)))
        return out


@lru_cache(maxsize=2)
def codec(path: str, parse_special: bool) -> TextCodec:
    """One codec for each Python worker and file."""
    return TextCodec(path, parse_special)


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", parse_special: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row: decimal ids joined by a space, and the text they decode to.

    Null and empty texts, and texts of white space only, have no tokens and decode to the empty string. Repeated rows
    are encoded each by itself. Texts are never cut, however long. ``parse_special``: the tokenizer's special tokens in
    a text become their ids, as the tokenizers library does unless told otherwise.
    """
    return _mapped(docs, tokenizer_path, id_col, text_col, parse_special, digests=False)


def digest_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", parse_special: bool = True) -> DataFrame:
    """As ``encode_documents``, with SHA-256 digests (ids_sha256, decoded_sha256) in place of ids and text, so that no
    encoded text leaves the task."""
    return _mapped(docs, tokenizer_path, id_col, text_col, parse_special, digests=True)


def _mapped(docs: DataFrame, path: str, id_col: str, text_col: str, parse_special: bool, digests: bool) -> DataFrame:
    def make():
        own = codec(path, parse_special)

        def step(batch: pa.RecordBatch) -> dict:
            n_tokens, left, right = [], [], []
            texts = batch.column("text")
            for at in range(0, len(texts), TEXTS_AT_ONCE):
                for ids, decoded in own.encode(texts.slice(at, TEXTS_AT_ONCE).to_pylist()):
                    n_tokens.append(ids.count(" ") + 1 if ids else 0)
                    left.append(hashlib.sha256(ids.encode()).hexdigest() if digests else ids)
                    right.append(hashlib.sha256(decoded.encode()).hexdigest() if digests else decoded)
            a, b = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
            return {"doc_id": batch.column("doc_id"), "n_tokens": n_tokens, a: left, b: right}

        return step

    a, b = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    return map_batches(keyed_text(docs, id_col, text_col), make, f"doc_id long, n_tokens long, {a} string, {b} string")


def decode_ids(tokens: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) from decimal ids joined by a space. Null or empty ids decode to the empty string; an id that
    the vocabulary lacks is an error."""
    def make():
        names = codec(tokenizer_path, True).words.names

        def step(batch: pa.RecordBatch) -> dict:
            return {"doc_id": batch.column("doc_id"), "decoded": [" ".join([names[int(i)] for i in t.split()]) for t in batch.column("text").to_pylist()]}

        return step

    return map_batches(keyed_text(tokens, id_col, ids_col), make, "doc_id long, decoded string")
