"""Anchors: a short run of a file's lines that is found again after edits nearby."""

from __future__ import annotations

from itertools import chain

SHORTEST, LONGEST, SPAN, NEAR, MOST_HITS = 12, 400, 4, 5, 3


def normalised(text: str) -> str:
    return " ".join(text.split())


class LineIndex:
    """A file's lines in normalised white space, each with the text that an anchor starting in it may cover."""

    def __init__(self, lines: list[str]):
        self.plain = list(map(normalised, lines))
        self.reach = [self.text_of(k, k + SPAN) for k in range(len(lines))]

    def text_of(self, start: int, stop: int) -> str:
        return " ".join(filter(None, self.plain[start:stop]))

    def hits(self, anchor: str) -> list[int]:
        """1-based lines in which an anchor starts, if SPAN lines from there hold it."""
        needle = normalised(anchor)
        if not needle:
            return []
        # an earliest occurrence behind the line's own text starts in a later line
        return [k for k, (own, text) in enumerate(zip(self.plain, self.reach), 1) if 0 <= text.find(needle) < len(own)]

    def build(self, line: int) -> str | None:
        """The shortest anchor of a 1-based line: lines downward, then upward, or None."""
        down = ((line - 1, line + more) for more in range(SPAN))
        up = ((line - 1 - more, line) for more in range(1, SPAN))
        within = (self.text_of(*s) for s in chain(down, up) if 0 <= s[0] and s[1] <= len(self.plain))
        return next((a for a in within if SHORTEST <= len(a) <= LONGEST and self._tells(a, line)), None)

    def _tells(self, anchor: str, line: int) -> bool:
        return self.verify(anchor, line)[0] == "ok"

    def verify(self, anchor: str, line: int) -> tuple[str, int]:
        """(verdict, line): ok with the corrected line, or why not."""
        hits = self.hits(anchor) if len(normalised(anchor)) >= SHORTEST else []
        near = [h for h in hits if abs(h - line) <= NEAR]
        if len(hits) > MOST_HITS:
            return "too_common", line
        if len(near) == 1:
            return "ok", near[0]
        return ("ambiguous" if near else "not_found"), line
