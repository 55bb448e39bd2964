"""Plain Python versions of text operators, step by step, for small tables."""

from __future__ import annotations

import difflib
import re

from inkmill.functions import rules

VALID = {*rules.COMMON_WORDS, *rules.GAME_TERMS}


def correct_word(word: str, valid=VALID, sure: float = 0.7) -> tuple[str, float]:
    low = word.lower()
    if len(word) < 3 or low in valid:
        return word, 1.0
    for p, by in rules.OCR_REPAIRS:
        if re.match(p, word):
            return by, 0.95
    ratio = {v: difflib.SequenceMatcher(None, low, v).ratio() for v in valid if v[:2] == low[:2] and abs(len(v) - len(word)) <= 2} if len(word) <= 20 else {}
    near = sorted((-r, v) for v, r in ratio.items() if r > 0.8 and r >= sure)
    if not near:
        return word, 1.0
    return (near[0][1].capitalize() if word[0].isupper() else near[0][1]), -near[0][0]


def join_hyphens(text: str, valid=VALID) -> str:
    def joined(m):
        word = m[1] + m[2]
        new, sure = correct_word(word, valid)
        return word if word.lower() in valid else new if sure > 0.9 else f"{m[1]} {m[2]}"

    for p in rules.HYPHENATION:
        text = re.sub(p, joined, text)
    return text.replace("\xad", "")


def correct_text(text: str | None, valid=VALID, aggressive: bool = False) -> str | None:
    if text is None:
        return None
    text = join_hyphens(text, valid)
    for p, by in rules.OCR_REPAIRS:
        text = re.sub(p, by, text)
    known: dict[str, str] = {}

    def put(m):
        if m[0] not in known:
            new, sure = correct_word(m[0], valid)
            known[m[0]] = new if sure >= 0.7 else m[0]
        return known[m[0]]

    return re.sub(r"(?:[^\W_]|')+" if aggressive else r"\w+", put, text)
