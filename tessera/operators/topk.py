"""The best rows of each question in a partition, so that a ranking shuffles a few rows of each partition alone."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Scores so near to the last one that counts are kept too; the final ranking settles the order.
SLACK = 2e-9
#: Rows that are held before they are cut down to the best.
HELD = 1 << 20
SCORED = "q_id long, chunk_no long, score double"


class Best:
    """Rows (question, number, score); of each question the limit best ones stay, and what ties with the last of them."""

    def __init__(self, questions: np.ndarray, limit: int | None):
        self.questions, self.limit = questions, limit
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, scores: np.ndarray, numbers: np.ndarray, above: float = -np.inf) -> None:
        """scores has a row for each question and a column for each number; those not above a value are left out."""
        if not scores.size:
            return
        keep = scores > above
        if self.limit is not None and self.limit < len(numbers):
            cut = np.partition(scores, len(numbers) - self.limit, axis=1)[:, len(numbers) - self.limit]
            keep &= scores >= cut[:, None] - SLACK
        q, c = np.nonzero(keep)
        self.rows.append((q, numbers[c], scores[q, c]))
        self.held += len(q)
        if self.limit is not None and self.held > max(HELD, 4 * self.limit * len(self.questions)):
            self.cut()

    def cut(self) -> None:
        q, number, score = map(np.concatenate, zip(*self.rows, strict=True))
        if self.limit is not None:
            order = np.lexsort((-score, q))
            q, number, score = q[order], number[order], score[order]
            first = np.searchsorted(q, q)
            last = np.minimum(first + self.limit - 1, np.searchsorted(q, q, side="right") - 1)
            keep = score >= score[last] - SLACK
            q, number, score = q[keep], number[keep], score[keep]
        self.rows, self.held = [(q, number, score)], len(q)

    def batch(self) -> pa.RecordBatch | None:
        if not self.rows:
            return None
        self.cut()
        q, number, score = self.rows[0]
        return pa.RecordBatch.from_pydict({"q_id": pa.array(self.questions[q], pa.int64()), "chunk_no": pa.array(number, pa.int64()), "score": pa.array(score, pa.float64())})
