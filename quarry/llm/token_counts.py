"""Token counts by trie-shared dynamic programming over a unigram vocabulary.

Texts are cut into pre-tokens (white-space words, each behind the word mark). The distinct pre-tokens of
a slice of documents form a byte trie, built level by level, and the unigram forward score of a prefix
(the best sum of piece scores that spells it) is computed once per trie node, so words share the work of
a common prefix. The node where a word ends stores its token count; a document's count is a sum over its
words. A worker remembers finished words up to a fixed number.

A word of more than ``TRIE_DEPTH`` bytes (a base64 run, say) would be one lonely path of as many levels. Its pieces are
looked up for all places at once instead, and one pass over the matches gives the same forward scores.

Scores: the vocabulary file gives pieces in order of rank; a piece's score is the log probability of its
rank under Zipf's law, ``-ln(rank + RANK_OFFSET)``. A byte that no piece spells costs one token of score
``BYTE_SCORE``. Equal scores go to the segmentation with fewer tokens.

Edge cases: null, empty and blank texts have 0 tokens; null ids and repeated rows are counted each; an
empty table gives an empty result; other columns are not read; words may be of any length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quarry.llm import textbytes as tb
from quarry.session import arrow_map

MARK = "▁"
RANK_OFFSET = 2.7
BYTE_SCORE = -16.0
REMEMBERED_WORDS = 400_000
TRIE_DEPTH = 512


def load_vocabulary(model_path: str) -> dict[bytes, float]:
    """Pieces of a SentencePiece file with their rank scores; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces: dict[bytes, float] = {}
    rank = 0
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        rank += 1
        pieces[model.id_to_piece(i).encode()] = -math.log(rank + RANK_OFFSET)
    return pieces


class TrieCounter:
    """Forward scores over a trie of byte strings, one level of the trie at a time."""

    def __init__(self, pieces: dict[bytes, float]):
        self.longest = max(map(len, pieces), default=1)
        by_hash = {}
        for piece, score in pieces.items():
            h = 0
            for c in piece:
                h = (h * int(tb.STEP) + int(tb.BYTE_CODE[c])) & (2**64 - 1)
            by_hash[h] = score
        self.keys = np.array(sorted(by_hash), np.uint64)
        self.scores = np.array([by_hash[int(k)] for k in self.keys])
        self.lengths = sorted({len(p) for p in pieces})
        self._length_set = frozenset(self.lengths)

    def _found(self, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.minimum(np.searchsorted(self.keys, piece), len(self.keys) - 1)
        return self.keys[i] == piece, self.scores[i]

    def long_count(self, word: np.ndarray) -> int:
        """Token count of one word, without a trie."""
        n = len(word)
        pref = np.zeros(n + 1, np.uint64)
        np.cumsum(tb.BYTE_CODE[word] * tb.powers("down", n), out=pref[1:])
        pref[1:] *= tb.powers("up", n)
        ends, lengths, scores = [], [], []
        for k in self.lengths:
            if k > n:
                break
            ok, score = self._found(pref[k:] - pref[: n + 1 - k] * np.uint64(pow(int(tb.STEP), k, 2**64)))
            at = np.flatnonzero(ok)
            ends.append(at + k)
            lengths.append(np.full(len(at), k))
            scores.append(score[at])
        end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        order = np.argsort(end, kind="stable")
        first = np.searchsorted(end[order], np.arange(n + 2)).tolist()
        length, score = np.concatenate(lengths)[order].tolist() if ends else [], np.concatenate(scores)[order].tolist() if ends else []
        best, cnt = [0.0] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            s, k = best[i - 1] + BYTE_SCORE, cnt[i - 1] + 1
            for m in range(first[i], first[i + 1]):
                j = i - length[m]
                now = best[j] + score[m]
                if now > s or (now == s and cnt[j] + 1 < k):
                    s, k = now, cnt[j] + 1
            best[i], cnt[i] = s, k
        return cnt[n]

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Token count of data[start:end] for each span."""
        n = len(starts)
        out = np.zeros(n, np.int64)
        long = ends - starts > TRIE_DEPTH
        for i in np.flatnonzero(long).tolist():
            out[i] = self.long_count(data[starts[i] : ends[i]])
        live = np.flatnonzero(~long)  # words that go on at this level
        node = np.zeros(len(live), np.int64)  # their node in the level above
        # for each depth back: score, count and prefix hash by node, kept for the longest piece only
        best, cnt, pref = [np.zeros(1)], [np.zeros(1, np.int64)], [np.zeros(1, np.uint64)]
        up: list[np.ndarray] = []  # parent links between those levels
        depth = 0
        power = [1]
        while True:
            ended = ends[live] - starts[live] == depth
            out[live[ended]] = cnt[-1][node[ended]]
            live, node = live[~ended], node[~ended]
            if not len(live):
                return out
            byte = data[starts[live] + depth]
            keys, child = np.unique(node * 256 + byte, return_inverse=True)
            parent, c = keys >> 8, (keys & 255).astype(np.int64)
            h = pref[-1][parent] * tb.STEP + tb.BYTE_CODE[c]
            s = best[-1][parent] + BYTE_SCORE
            k = cnt[-1][parent] + 1
            up.append(parent)
            at = parent
            for back in range(1, min(depth + 1, self.longest) + 1):
                if back > 1:
                    at = up[-back][at]
                while len(power) <= back:
                    power.append(power[-1] * int(tb.STEP) & (2**64 - 1))
                if back not in self._length_set:
                    continue
                piece = h - pref[-back][at] * np.uint64(power[back])
                ok, score = self._found(piece)
                score = best[-back][at] + np.where(ok, score, -np.inf)
                count = cnt[-back][at] + 1
                better = (score > s) | ((score == s) & (count < k))
                s, k = np.where(better, score, s), np.where(better, count, k)
            best.append(s)
            cnt.append(k)
            pref.append(h)
            if len(best) > self.longest:
                best.pop(0), cnt.pop(0), pref.pop(0), up.pop(0)
            node = child
            depth += 1


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_words, n_tokens."""
    pieces = load_vocabulary(model_path)
    mark = MARK.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = TrieCounter(pieces)
        known_h, known_c = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for rows, data, offs in tb.slices(batches, "text"):
            s, e, r = tb.words(data, offs)
            n = len(offs) - 1
            h = tb.span_hashes(data, s, e)
            uniq, first, back = np.unique(h, return_index=True, return_inverse=True)
            count = np.zeros(len(uniq), np.int64)
            at = np.minimum(np.searchsorted(known_h, uniq), max(len(known_h) - 1, 0))
            new = known_h[at] != uniq if len(known_h) else np.ones(len(uniq), bool)
            if len(known_h):
                count[~new] = known_c[at[~new]]
            if new.any():
                fs, fe = s[first[new]], e[first[new]]
                # lay the new words out once more, each behind the word mark
                sizes = fe - fs + len(mark)
                ends = np.cumsum(sizes)
                begins = ends - sizes
                laid = np.empty(int(ends[-1]), np.uint8)
                for j, b in enumerate(mark):
                    laid[begins + j] = b
                body = np.repeat(fs - begins - len(mark), fe - fs)
                where = np.arange(int((fe - fs).sum())) + np.repeat(begins + len(mark) - np.concatenate([[0], np.cumsum(fe - fs)[:-1]]), fe - fs)
                laid[where] = data[where + body]
                count[new] = trie.counts(laid, begins, ends)
                if len(known_h) + int(new.sum()) > REMEMBERED_WORDS:
                    known_h, known_c = known_h[:0], known_c[:0]
                place = np.searchsorted(known_h, uniq[new])
                known_h, known_c = np.insert(known_h, place, uniq[new]), np.insert(known_c, place, count[new])
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array(np.bincount(r, minlength=n).astype(np.int64)),
                    pa.array(np.bincount(r, weights=count[back], minlength=n).astype(np.int64) if len(r) else np.zeros(n, np.int64)),
                ],
                ["doc_id", "n_words", "n_tokens"],
            )

    schema = StructType([docs.schema["doc_id"], StructField("n_words", LongType()), StructField("n_tokens", LongType())])
    return arrow_map(docs.select("doc_id", "text"), run, schema)


def totals(counts: DataFrame) -> DataFrame:
    return counts.agg(F.sum("n_words").alias("n_words"), F.sum("n_tokens").alias("n_tokens"))
