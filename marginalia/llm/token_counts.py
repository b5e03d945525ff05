"""Token counts under a unigram vocabulary by dynamic programming that pre-tokens share in a trie.

The best cut of a prefix does not depend on what follows it. Distinct pre-tokens, visited in sorted order, are the
leaves of their trie in depth-first order; the stack of best scores and token counts along the current path is kept, so
the forward scores of a prefix that many words share are worked out once. What is stored of a pre-token is the count at
its terminal. An automaton over the vocabulary names the pieces that end at each letter.

Tries are built a task and a batch at a time, over pre-tokens the task has not met. Nothing is shuffled, and the memory
a task keeps is bounded by ``WORDS_KEPT``.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from marginalia.llm.common import keyed_text, map_batches

WORDS_KEPT = 500_000
TEXTS_AT_ONCE = 2048
#: Stands for the white space before a word.
SPACE = "▁"
#: How much less than the least score a letter without a piece scores; it counts as its UTF-8 bytes.
UNKNOWN_PENALTY = 10.0


def ranked_pieces(model_path: str) -> list[tuple[str, float]]:
    """Pieces of a merge-ranked vocabulary file with log probabilities by Zipf's law: the one of rank r has 1/(r + 1) of
    the first one's. (The file's own scores are just ranks.)"""
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    total = math.log(math.fsum(1 / (r + 1) for r in range(len(plain))))
    return [(model.id_to_piece(i), -math.log(r + 1) - total) for r, i in enumerate(plain)]


class UnigramTrie:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.step: dict[int, int] = {}
        self.ends: list[tuple[tuple[float, int], ...]] = [()]
        levels: list[list[tuple[int, int, int]]] = []
        for text, score in pieces:
            state = 0
            for d, c in enumerate(text):
                key = state << 21 | ord(c)
                if key not in self.step:
                    self.step[key] = len(self.ends)
                    self.ends.append(())
                    if d == len(levels):
                        levels.append([])
                    levels[d].append((state, ord(c), self.step[key]))
                state = self.step[key]
            if state:
                self.ends[state] = ((score, len(text)),)
        self.back = [0] * len(self.ends)
        for level in levels:
            for parent, c, state in level:
                self.back[state] = self.follow(self.back[parent], c) if parent else 0
                self.ends[state] += self.ends[self.back[state]]
        self.known: dict[str, int] = {}

    def follow(self, state: int, c: int) -> int:
        while (to := self.step.get(state << 21 | c)) is None:
            if not state:
                return 0
            state = self.back[state]
        return to

    def count_words(self, words) -> dict[str, int]:
        """Tokens of the best cut of each distinct pre-token; of cuts that score alike, the one whose last piece is the
        longest."""
        out: dict[str, int] = {}
        step, ends, unknown = self.step, self.ends, self.unknown
        longest = max(map(len, words), default=0) + 1
        states, scores, counts = [0] * longest, [0.0] * longest, [0] * longest
        before = ""
        for text in sorted(words):
            shared = 0
            for x, y in zip(before, text):
                if x != y:
                    break
                shared += 1
            state = states[shared]
            for i in range(shared, len(text)):
                c = ord(text[i])
                to = step.get(state << 21 | c)
                state = self.follow(state, c) if to is None else to
                best, count, length = -math.inf, 0, 0
                for score, length in ends[state]:
                    score += scores[i + 1 - length]
                    if score > best:
                        best, count = score, counts[i + 1 - length] + 1
                if length != 1:  # the shortest piece that ends here comes last: no piece is this letter alone
                    score = scores[i] + unknown
                    if score > best:
                        best, count = score, counts[i] + len(text[i].encode("utf-8", "surrogatepass"))
                states[i + 1], scores[i + 1], counts[i + 1] = state, best, count
            out[text] = counts[len(text)]
            before = text
        return out

    def count_texts(self, texts: list[str]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        cut = [t.split() for t in texts]
        fresh = set().union(*cut).difference(self.known)
        if len(self.known) + len(fresh) > WORDS_KEPT:
            self.known.clear()
            fresh = set().union(*cut)
        counted = self.count_words({SPACE + w for w in fresh})
        known = self.known
        known.update((w[1:], n) for w, n in counted.items())
        return [(len(words), sum(map(known.__getitem__, words))) for words in cut]


@lru_cache(maxsize=2)
def trie(model_path: str) -> UnigramTrie:
    return UnigramTrie(ranked_pieces(model_path))


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) of every row.

    Pre-tokens are the words between white space, each with a space mark before it. Null and empty texts, and those of
    white space only, count nothing. Repeated rows are counted each by itself; texts are never cut.
    """
    def make():
        own = trie(model_path)

        def step(batch: pa.RecordBatch) -> dict:
            texts = batch.column("text")
            counts = [c for at in range(0, len(texts), TEXTS_AT_ONCE) for c in own.count_texts(texts.slice(at, TEXTS_AT_ONCE).to_pylist())]
            return {"doc_id": batch.column("doc_id"), "n_pretokens": [c[0] for c in counts], "n_tokens": [c[1] for c in counts]}

        return step

    return map_batches(keyed_text(docs, id_col, text_col), make, "doc_id long, n_pretokens long, n_tokens long")
