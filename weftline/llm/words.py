"""Words of a text in a form for comparisons: case, accents, punctuation, spacing and same-looking characters don't count."""

from __future__ import annotations

from weftline.llm.lookalike import folded


class WordFolder:
    """Folds words with a bounded memory of those seen."""

    def __init__(self, bound: int = 500_000):
        self.known: dict[str, str] = {}
        self.bound = bound

    def word(self, raw: str) -> str:
        got = self.known.get(raw)
        if got is None:
            if len(self.known) >= self.bound:
                self.known.clear()
            got = self.known[raw] = "".join(filter(str.isalnum, folded(raw)))
        return got

    def words(self, text: str | None) -> list[str]:
        return [w for w in map(self.word, (text or "").split()) if w]
