r"""Formulas in brackets, \[...\] and \(...\), to formulas in dollars; code and links stay as they are."""

from __future__ import annotations

import re

#: Commands that are formulas even without brackets, and the patterns of formulas, code and links.
HINTS = frozenset(
    "times cdot otimes oplus div pm mp frac sqrt sum prod int leq geq neq approx alpha beta gamma theta lambda mu sigma pi "
    "boldsymbol mathbf mathrm mathit text uparrow downarrow left right".split()
)
LATEX = re.compile(r"\$[^$\n]*\$|\\[A-Za-z]{2,}")
BRACKETS = ((r"\[", r"\]", "$$"), (r"\(", r"\)", "$"))
KEPT = re.compile(r"```[\s\S]*?```|`[^`]*`")
LINK = re.compile(r"\[([^\[\]]*(?:\[[^\]]*\][^\[\]]*)*)\]\([^)]*?\)")
DOLLARS = re.compile(r"(\$\$[\s\S]*?\$\$|\$[^$\n]+\$)")
COMMAND = re.compile(r"\\([A-Za-z]{2,})(?:\s*\{[^{}]*\})*")


def _unescaped(formula: str) -> str:
    return re.sub(r"\\\\(?=[A-Za-z])", lambda _: "\\", formula)


def bracketed(text: str, left: str, right: str, mark: str) -> str:
    """Balanced brackets become ``mark``; one with an odd number of backslashes before it is none, and an open one stays.

    One pass with the places of open brackets: where the outermost never closes, what is balanced inside it counts.
    """
    marks = [(m.start(), m.group() == left) for m in re.finditer(f"{re.escape(left)}|{re.escape(right)}", text) if not _odd(text, m.start())]
    # the partner of each opening bracket, found once for all of them
    partner: dict[int, int] = {}
    opened: list[int] = []
    for at, opens in marks:
        if opens:
            opened.append(at)
        elif opened:
            partner[opened.pop()] = at
    out, done = [], 0
    for at, opens in marks:
        if opens and at >= done and at in partner:
            end = partner[at]
            out += [text[done:at], mark, _unescaped(text[at + len(left) : end]), mark]
            done = end + len(right)
    return "".join([*out, text[done:]])


def _odd(text: str, at: int) -> bool:
    n = 0
    while at - n > 0 and text[at - n - 1] == "\\":
        n += 1
    return n % 2 == 1


def _by_segment(text: str, formula, prose) -> str:
    return "".join(formula(s) if i % 2 else prose(s) for i, s in enumerate(DOLLARS.split(text)))


def dollars(text: str) -> str:
    """A text with its bracketed formulas in dollars, and lone commands that are formulas put into dollars too."""
    if not LATEX.search(text) and not any(a in text and b in text[text.index(a) :] for a, b, _ in BRACKETS):
        return text
    kept: list[str] = []
    mark = "\ue000"
    while mark in text:
        mark += "\ue001"

    def keep(m: re.Match) -> str:
        kept.append(m.group())
        return f"{mark}{len(kept) - 1};"

    out = KEPT.sub(keep, text)
    out = LINK.sub(keep, out) if "](" in out else out
    out = _by_segment(out, _unescaped, str)
    for left, right, dollar in BRACKETS:
        out = bracketed(out, left, right, dollar)
    out = _by_segment(out, str, lambda s: COMMAND.sub(lambda m: f"${_unescaped(m.group())}$" if m[1].lower() in HINTS else m.group(), s))
    back = re.compile(f"{mark}(\\d+);")
    while back.search(out):  # a link may hold code
        out = back.sub(lambda m: kept[int(m[1])], out)
    return out
