"""The clause model: typed clauses, the rule grammar, and contracts.

A contract's quality clauses are dictionaries of five types: not_null, unique,
accepted_values, custom (with a rule in a small grammar) and ai_extension.
Soda-style check lines are a sixth form.  Parsing is strict about what it
claims to understand: a rule outside the grammar is `unknown`, and reported so.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

NUMBER = r"([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"
OPERATOR = r"(<=|>=|==|!=|<|>)"


@dataclass(frozen=True)
class Rule:
    """A parsed rule: its kind and arguments."""

    kind: str
    args: tuple = ()


#: The grammar, first match wins.  `value` forms come before column comparisons.
GRAMMAR = [
    ("regex", re.compile(r"^regex:\s*(.+)$", re.S)),
    ("count_gte", re.compile(r"COUNT\(\*\)\s*>=\s*(\d+)?", re.I)),
    ("edge_references", re.compile(r"edge\.source IN nodes\[\*\]\.(\w+) AND edge\.target IN nodes\[\*\]\.\w+")),
    ("sequence", re.compile(r"(?:(\w+)\s*=\s*)?ROW_NUMBER\(\)(?:.*PARTITION BY (\w+))?(?:.*ORDER BY (\w+))?", re.I | re.S)),
    ("mean_range", re.compile(rf"^{NUMBER}\s*<=\s*mean\s*<=\s*{NUMBER}$")),
    ("statistical_bounds", re.compile(r"(?=.*mean)(?=.*stddev)")),
    ("not_future", re.compile(r"^(\w+)\s*<=\s*NOW\(\)$", re.I)),
    ("value_bound", re.compile(rf"^value\s*{OPERATOR}\s*{NUMBER}$")),
    ("value_range", re.compile(rf"^{NUMBER}\s*<=\s*value\s*<=\s*{NUMBER}$")),
    ("len_bound", re.compile(rf"^len\(value\)\s*{OPERATOR}\s*(\d+)$")),
    ("additive", re.compile(r"^(\w+)\s*==\s*(\w+)\s*\+\s*(\w+)$")),
    ("columns", re.compile(rf"^(\w+)\s*{OPERATOR}\s*(\w+)$")),
]


def parse_rule(text: str | None) -> Rule:
    text = (text or "").strip()
    for kind, pattern in GRAMMAR:
        if m := pattern.search(text):
            return Rule(kind, m.groups())
    return Rule("unknown", (text,))


@dataclass(frozen=True)
class Clause:
    type: str
    name: str = ""
    fields: tuple[str, ...] = ()
    values: tuple[str, ...] | None = None
    pattern: str | None = None
    rule_text: str = ""
    breaking: bool = False
    profile: dict = field(default_factory=dict, hash=False)
    keys: dict = field(default_factory=dict, hash=False)

    @property
    def rule(self) -> Rule:
        return parse_rule(self.rule_text)

    @classmethod
    def from_dict(cls, d: dict) -> "Clause":
        fields = d.get("fields") or ([d["field"]] if d.get("field") else [])
        return cls(
            type=d.get("type", ""), name=d.get("name", ""), fields=tuple(fields),
            values=tuple(map(str, d["values"])) if d.get("values") else None, pattern=d.get("pattern"),
            rule_text=d.get("rule", ""), breaking=bool(d.get("breaking_if_violated", False)), profile=d.get("observed_profile") or {},
            keys={k: d[k] for k in ("required_output_keys", "required_input_keys") if k in d},
        )


SODA = re.compile(rf"^(missing_count|duplicate_count|min|max|avg|row_count)(?:\(([^)]*)\))?\s*(=|{OPERATOR[1:-1]})\s*{NUMBER}$")


def parse_soda(line: str) -> Clause:
    """A check line such as `missing_count(order_id) = 0` or `row_count >= 1`."""
    m = SODA.match(line.strip())
    if not m:
        return Clause("custom", name="soda", rule_text=line)
    metric, of, op, bound = m.groups()
    return Clause("soda", name=metric, fields=(of,) if of else (), rule_text="==" if op == "=" else op, profile={"bound": float(bound), "line": line.strip()})


@dataclass(frozen=True)
class Contract:
    id: str
    stem: str
    clauses: tuple[Clause, ...]
    path: str | None = None

    @classmethod
    def from_dict(cls, d: dict, stem: str) -> "Contract":
        """Clauses of quality_extended, or else those of quality; Soda lines of quality are always added."""
        given = d.get("quality_extended") or [c for c in d.get("quality") or [] if isinstance(c, dict)]
        if not isinstance(given, list):
            given = []
        clauses = [Clause.from_dict(c) for c in given]
        return cls(str(d.get("id", stem)), stem, tuple(clauses), ((d.get("servers") or {}).get("local") or {}).get("path"))

    @staticmethod
    def soda_clauses(d: dict) -> tuple[Clause, ...]:
        quality = d.get("quality")
        spec = quality.get("specification") if isinstance(quality, dict) else None
        lines = [x for v in (spec or {}).values() for x in v] if isinstance(spec, dict) else []
        return tuple(parse_soda(x) for x in lines if isinstance(x, str))
