"""Split plans: a small language for how documents are cut.

``document / drift or "x" / part over-budget``: stages between slashes, each one or
several atoms joined by ``or`` or ``and``, with an optional ``over-budget``.
Atoms: document, part, drift, "a literal", label=value.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

_ATOM = re.compile(r'\s*("(?:[^"\\]|\\.)*"|[^\s"/]+)')


@dataclass(frozen=True)
class Atom:
    kind: str  # document, part, drift, separator, label
    value: str = ""
    label: str = ""

    def text(self) -> str:
        return {"separator": json.dumps(self.value, ensure_ascii=False), "label": f"{self.label}={self.value}"}.get(self.kind, self.kind)


@dataclass(frozen=True)
class Stage:
    atoms: tuple[Atom, ...]
    join: str = "or"
    over_budget: bool = False

    def text(self) -> str:
        return f" {self.join} ".join(a.text() for a in self.atoms) + (" over-budget" if self.over_budget else "")


def _stages(text: str) -> list[str]:
    parts, quoted, current = [], False, ""
    for i, c in enumerate(text):
        if c == '"' and (i == 0 or text[i - 1] != "\\"):
            quoted = not quoted
        if c == "/" and not quoted:
            parts.append(current)
            current = ""
        else:
            current += c
    return [*parts, current]


def parse(text: str) -> tuple[Stage, ...]:
    """The stages of a plan; ValueError with all problems if it is none."""
    out, problems = [], []
    for n, part in enumerate(_stages(text), 1):
        words = _ATOM.findall(part)
        over = bool(words) and words[-1] == "over-budget"
        words = words[:-1] if over else words
        joins = {w for w in words[1::2]}
        if not words or len(words) % 2 == 0 or not joins <= {"or", "and"} or len(joins) > 1:
            problems.append(f"stage {n}: atoms joined by one of or, and are expected: {part.strip()!r}")
            continue
        atoms = []
        for w in words[::2]:
            if w.startswith('"'):
                atoms.append(Atom("separator", json.loads(w)))
            elif w in ("document", "part", "drift"):
                atoms.append(Atom(w))
            elif "=" in w:
                label, _, value = w.partition("=")
                atoms.append(Atom("label", value, label))
            else:
                problems.append(f"stage {n}: unknown atom {w!r}")
        out.append(Stage(tuple(atoms), next(iter(joins), "or"), over))
    if out and out[0].atoms and out[0].atoms[0].kind not in ("document", "part"):
        problems.append("the first stage must be document or part")
    if any(a.kind == "separator" and not a.value for s in out for a in s.atoms):
        problems.append("a separator must not be empty")
    if problems:
        raise ValueError("; ".join(problems))
    return tuple(out)


def canonical(plan: tuple[Stage, ...]) -> str:
    return " / ".join(s.text() for s in plan)
