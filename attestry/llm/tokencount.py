"""Token counts under a unigram vocabulary, by a Viterbi that keeps only best score and piece count.

An Aho-Corasick automaton of the vocabulary lists every piece that ends at a place; the best
segmentation up to each place is carried as (score, pieces). The rules are those of the sentencepiece
library's unigram decoder: of equal scores the piece that starts first stays; a place without a piece
of one character gets an unknown one at the least score less 10, which byte fallback spells as one
piece a byte; text is preceded by one space; spaces become U+2581. Scores are added exactly; the
library adds 32-bit floats over a whole text and so departs from its own rules once a sum passes 2^24.

No piece has U+2581 after another character, so no piece crosses from a character into a space, and
the text falls into runs (spaces, then others) that are solved apart; tasks remember common runs.
Defined cases: null and empty texts have no tokens; one result row for each row of documents, repeats
included; an empty table gives an empty result.
"""

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
KEPT = 1 << 18
RUN = re.compile(f"{SPACE}+[^{SPACE}]*")


def load_pieces(path: str) -> dict[str, float]:
    """The ordinary pieces of a vocabulary file and their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    out = {model.id_to_piece(i): model.get_score(i) for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))}
    if any(SPACE in piece.lstrip(SPACE) for piece in out):
        raise ValueError("a piece crosses from a character into a space")
    return out


class Counter(dict):
    """Tokens of runs: (score, pieces), computed once for runs that fit."""

    def __init__(self, pieces: dict[str, float]):
        super().__init__()
        self.match = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.match.add_word(piece, (len(piece), score))
        self.match.make_automaton()
        self.unknown = min(pieces.values()) - UNKNOWN_PENALTY

    def __missing__(self, run: str) -> tuple[float, int]:
        value = self.best(run)
        if len(run) <= 48:
            if len(self) >= KEPT:
                self.clear()
            self[run] = value
        return value

    def best(self, run: str) -> tuple[float, int]:
        n = len(run)
        score, count = [0.0] + [None] * n, [0] * (n + 1)
        done = 0  # places up to here have had their turn

        def unknown_until(end: int) -> None:
            nonlocal done
            while done < end:
                done += 1
                if done not in single:
                    s = score[done - 1] + self.unknown
                    if score[done] is None or s > score[done]:
                        score[done], count[done] = s, count[done - 1] + len(run[done - 1].encode("utf-8", "surrogatepass"))

        single = set()
        for at, (length, own) in self.match.iter(run):  # longest first at each place, so starts ascend
            end = at + 1
            unknown_until(at)
            s = score[end - length] + own
            if score[end] is None or s > score[end]:
                score[end], count[end] = s, count[end - length] + 1
            if length == 1:
                single.add(end)
        unknown_until(n)
        return score[n], count[n]


def count(text: str | None, counter: Counter) -> tuple[int, float]:
    """Tokens and score of a text."""
    if not text:
        return 0, 0.0
    tokens, score = 0, 0.0
    for run in RUN.findall(SPACE + text.replace(" ", SPACE)):
        s, n = counter[run]
        tokens += n
        score += s
    return tokens, score


def _count(pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(pieces.value)
        for batch in batches:
            got = [count(t.as_py(), counter) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([n for n, _ in got], pa.int64()), pa.array([s for _, s in got], pa.float64())], ["doc_id", "n_tokens", "score"])

    return run


def token_counts(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and score (the best segmentation's log-probability) for each row of documents (doc_id, text)."""
    pieces = documents.sparkSession.sparkContext.broadcast(load_pieces(path))  # the vocabulary, of a fixed size
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_count(pieces), "doc_id long, n_tokens long, score double")
