"""Weighted finite-state transducers over token classes, and their composition.

A transducer reads tokens of a clause and rewrites them. The lexicon's two transducers (insults, threats)
turn words into marks with weights; those for negation, reported speech and targets each keep a small state
and change the marks that pass. Composed, they are one machine whose state is the tuple of their states.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

# Closed word classes in English, German, French and Spanish.
NEGATIONS = frozenset("not no never neither nor none isn't aren't wasn't don't doesn't didn't nicht kein keine keinen keiner nie niemals ne pas jamais aucun aucune ni nunca jamás ningún ninguna".split())
REPORTS = frozenset("said says say called calls wrote claimed claims reported quoted alleged sagte sagt nannte schrieb behauptet dit disait écrit appelé dijo dice llamó escribió".split())
TARGETS = frozenset("you your yours you're they them he him she her people everyone du dich dir ihr euch sie er tu te toi vous ils elles lui usted tú ti vosotros ellos ellas él ella".split())
THREATS = frozenset("kill hurt destroy shoot stab beat burn hang töten umbringen schlagen verbrennen tuer frapper brûler matar golpear quemar".split())
CLAUSE_ENDS = ".!?;:\n"
QUOTES = "\"“”„«»"

# Token classes.
INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, OTHER = range(7)
KINDS = ("insult", "threat")
FEATURES = tuple(f"{k}{m}" for k in KINDS for m in ("", "_targeted", "_negated", "_reported", "_negated_reported"))


@dataclass(frozen=True)
class Transducer:
    """step[state][class] -> (next state, marks on insults and threats that pass in that state)."""

    states: int
    arcs: dict[tuple[int, int], int]
    mark: dict[int, str] = field(default_factory=dict)
    decay: dict[int, int] = field(default_factory=dict)  # where another word leads

    def next(self, state: int, kind: int) -> int:
        return self.arcs.get((state, kind), self.decay.get(state, state))


# A negation reaches over the next four words.
NEGATING = Transducer(5, {(s, NEGATION): 4 for s in range(5)}, {s: "negated" for s in (1, 2, 3, 4)}, {s: s - 1 for s in (1, 2, 3, 4)})
# Reported speech reaches to the end of the clause; a quotation mark opens and closes it.
REPORTING = Transducer(3, {(0, REPORT): 1, (0, QUOTE): 2, (1, QUOTE): 2, (2, QUOTE): 0}, {1: "reported", 2: "reported"})
# A target stays in mind over six words.
AIMING = Transducer(7, {(s, TARGET): 6 for s in range(7)}, {s: "targeted" for s in range(1, 7)}, {s: s - 1 for s in range(1, 7)})

# A threat waits three words for the one it is aimed at.
WAITING = Transducer(4, {(s, THREAT): 3 for s in range(4)} | {(s, TARGET): 0 for s in range(4)}, {}, {s: s - 1 for s in (1, 2, 3)})
AIMS = -2  # output of a target that a threat waits for


class Machine:
    """The composition: arcs (state, class) -> (next state, feature of a mark, ``AIMS`` or -1)."""

    def __init__(self, parts: tuple[Transducer, ...] = (NEGATING, REPORTING, AIMING, WAITING)) -> None:
        numbers = {s: i for i, s in enumerate(itertools.product(*(range(p.states) for p in parts)))}
        self.arcs: list[list[tuple[int, int]]] = []
        for state in numbers:
            marks = {p.mark.get(s) for p, s in zip(parts, state)}
            row = []
            for kind in range(OTHER + 1):
                to = tuple(p.next(s, kind) for p, s in zip(parts, state))
                out = -1
                if kind in (INSULT, THREAT):
                    name = KINDS[kind]
                    if "negated" in marks and "reported" in marks:
                        name += "_negated_reported"
                    else:
                        name += next((f"_{m}" for m in ("negated", "reported", "targeted") if m in marks), "")
                    out = FEATURES.index(name)
                elif kind == TARGET and any(p is WAITING and s for p, s in zip(parts, state)):
                    out = AIMS
                row.append((numbers[to], out))
            self.arcs.append(row)

    def run(self, clause: list[tuple[int, float]]) -> list[float]:
        """Weights by feature of a clause of (class, weight) tokens."""
        state, out = 0, [0.0] * len(FEATURES)
        plain, aimed, waits = FEATURES.index("threat"), FEATURES.index("threat_targeted"), 0.0
        for kind, weight in clause:
            state, feature = self.arcs[state][kind]
            if feature >= 0:
                out[feature] += weight
                if kind == THREAT:
                    waits = weight if feature == plain else 0.0
            elif feature == AIMS and waits:
                out[plain] = max(0.0, out[plain] - waits)
                out[aimed] += waits
                waits = 0.0
        return out
