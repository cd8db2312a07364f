"""Token counts under a unigram model, with work shared by prefixes.

The best segmentation of a word into pieces is found from left to right: the best
score of a prefix is the best, over the pieces that end it, of the piece's score
and that of the shorter prefix. Words that begin alike share those scores. So the
distinct words of a batch go in a trie, level by level, and each node's score is
worked out once, for all nodes of a level together; the count at a word's last
node is the word's. Counts are kept for later batches of the same task.

The piece lists at hand have no probabilities; a piece's is taken from its rank
by Zipf's law. Scores are whole numbers, so ties are exact; they go to fewer tokens.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import arrow_batches, keyed, text_slices, utf8

SPACE_MARK = "▁"
KNOWN_WORDS = 400_000
# Longer words are worked out one by one, as a trie of them would be one path.
TRIE_CHARS = 128
_SCALE = 1 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


@dataclass
class Pieces:
    """Scores of pieces, and sorted hash arrays by length for the trie."""

    scores: dict[str, int]
    byte_score: int
    longest: int
    keys: list
    values: list
    endings: list


def read_pieces(path: str) -> Pieces:
    """The pieces of a sentencepiece file, scored by rank; bytes stand in for unknown letters."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    total = math.log(sum(1 / (r + 1) for r in range(len(names) + 1)))
    scores = {p: round(_SCALE * (-math.log(r + 1) - total)) for r, p in enumerate(names)}
    # A byte is less likely than any piece.
    least = round(_SCALE * (-math.log(len(names) + 1) - total))
    return made(scores, least)


def made(scores: dict[str, int], byte_score: int) -> Pieces:
    longest = max(map(len, scores), default=1)
    keys, values, endings = [None], [None], [None]
    for n in range(1, longest + 1):
        own = {_hash(p): s for p, s in scores.items() if len(p) == n}
        order = sorted(own)
        keys.append(np.array(order, _U))
        values.append(np.array([own[k] for k in order], np.int64))
        endings.append(np.unique(np.array([_hash(p[-n:]) for p in scores if len(p) >= n], _U)))
    return Pieces(scores, byte_score, longest, keys, values, endings)


def _hash(text: str) -> int:
    value = 0
    for c in text:
        value = (value * int(_FACTOR) + ord(c) + 1) & ((1 << 64) - 1)
    return value


def _bytes_of(code: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of code points."""
    return 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)


def count_one(word: str, pieces: Pieces) -> int:
    """Tokens of one word."""
    best = [(0, 0)]  # score and minus the number of tokens
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        score, count = best[end - 1]
        found = (score + n * pieces.byte_score, count - n)
        for size in range(1, min(end, pieces.longest) + 1):
            own = pieces.scores.get(word[end - size : end])
            if own is not None:
                score, count = best[end - size]
                found = max(found, (score + own, count - 1))
        best.append(found)
    return -best[-1][1]


def count_words(words: list[str], pieces: Pieces) -> np.ndarray:
    """Tokens of each of some distinct words, by a trie."""
    out = np.zeros(len(words), np.int64)
    for i in [i for i, w in enumerate(words) if len(w) > TRIE_CHARS]:
        out[i] = count_one(words[i], pieces)
    order = sorted((i for i, w in enumerate(words) if len(w) <= TRIE_CHARS), key=lambda i: words[i])
    if not order:
        return out
    index = np.array(order)
    sizes = np.fromiter((len(words[i]) for i in order), np.int64, len(order))
    code = np.frombuffer("".join(words[i] for i in order).encode("utf-32-le"), "<u4").astype(np.int64)
    first = np.cumsum(sizes) - sizes
    # One entry per level: best score and count, hash of the path, parent of each node.
    score, count = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    path, parent = [np.zeros(1, _U)], [np.zeros(1, np.int64)]
    node, live = np.zeros(len(order), np.int64), np.arange(len(order))
    powers = [_U(1)]
    for _ in range(pieces.longest):
        powers.append(_U(int(powers[-1]) * int(_FACTOR) & (1 << 64) - 1))
    level = 0
    while len(live):
        ended = sizes[live] == level
        out[index[live[ended]]] = count[level][node[live[ended]]]
        live = live[~ended]
        if not len(live):
            break
        letter, up = code[first[live] + level], node[live]
        new = np.ones(len(live), bool)
        new[1:] = (letter[1:] != letter[:-1]) | (up[1:] != up[:-1])
        node[live] = np.cumsum(new) - 1
        letter, up = letter[new], up[new]
        level += 1
        own_path = path[level - 1][up] * _FACTOR + letter.astype(_U) + _U(1)
        path.append(own_path)
        parent.append(up)
        n = _bytes_of(letter)
        best, tokens = score[level - 1][up] + n * pieces.byte_score, count[level - 1][up] + n
        at, above = np.arange(len(up)), up
        for size in range(1, min(level, pieces.longest) + 1):
            ending = own_path[at] - path[level - size][above] * powers[size]
            found = _places(pieces.keys[size], ending)
            hit = found >= 0
            if hit.any():
                a, b = at[hit], above[hit]
                s = score[level - size][b] + pieces.values[size][found[hit]]
                c = count[level - size][b] + 1
                better = (s > best[a]) | ((s == best[a]) & (c < tokens[a]))
                best[a[better]], tokens[a[better]] = s[better], c[better]
            # Only endings that some longer piece has can be lengthened.
            more = _places(pieces.endings[size], ending) >= 0
            at, above = at[more], above[more]
            if not len(at) or size == level:
                break
            above = parent[level - size][above]
        score.append(best)
        count.append(tokens)
    return out


def _places(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted key is, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def token_counts(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None
) -> DataFrame:
    """id, n_words, n_tokens for every row: tokens of all words, each with its space mark.

    Words are what white space (space, tab to carriage return) parts. Null and
    empty texts have none. Repeated rows and null ids each get a row.
    """
    rows = keyed(documents, id_col, text_col)
    spark = rows.sparkSession
    arrow_batches(spark)
    sent = spark.sparkContext.broadcast(read_pieces(str(path or public_tokenizers.path("piece_bpe_32k.model"))))

    def run(batches):
        pieces, known = sent.value, {}
        for batch in batches:
            texts, words_of, tokens_of = utf8(batch.column("text")), [], []
            for a, b in text_slices(texts):
                lists = [t.split() for t in texts[a:b]]
                new = sorted(set().union(*lists).difference(known))
                counts = count_words([SPACE_MARK + w.decode() for w in new], pieces)
                known.update(zip(new, counts.tolist()))
                words_of += map(len, lists)
                tokens_of += [sum(map(known.__getitem__, x)) for x in lists]
                if len(known) > KNOWN_WORDS:
                    known.clear()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(words_of, pa.int64()), pa.array(tokens_of, pa.int64())],
                ["id", "n_words", "n_tokens"],
            )

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_words bigint, n_tokens bigint")
