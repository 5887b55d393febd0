"""Rule documents: JSON with a base, and the engine's view of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from factloom.sources.store import Place, read_json


@dataclass(frozen=True)
class Phrase:
    """One lexical phrase; ``seq`` is its place among those of its kind."""

    seq: int
    kind: str  # category, generic, unmappable, unclear
    category: str
    rule_id: str
    text: str


@dataclass(frozen=True)
class Rules:
    """The lists that operators read. Keys of the document that no operator
    reads are left out; a list that is missing is empty."""

    version: str = ""
    phrases: tuple[Phrase, ...] = ()
    generic_cues: tuple[str, ...] = ()
    sections_allowed: tuple[str, ...] = ()
    sections_excluded: tuple[str, ...] = ()
    occurrence: tuple[str, ...] = ()
    non_event: tuple[str, ...] = ()
    zero_cells: tuple[str, ...] = ()
    missing_cells: tuple[str, ...] = ()
    arm_noise: tuple[str, ...] = ()
    times: tuple[str, ...] = ()
    table_safety: tuple[str, ...] = ()
    table_excluded: tuple[str, ...] = ()
    row_non_event: tuple[str, ...] = ()
    statistical: tuple[str, ...] = ()
    quote_limit: int = 800
    source: dict = field(default_factory=dict, compare=False, repr=False)


#: Field of Rules -> key of a rule document (a fixed format).
KEYS = {
    "generic_cues": "generic_reporting_cues",
    "sections_allowed": "body_allowed_section_patterns",
    "sections_excluded": "body_excluded_section_patterns",
    "occurrence": "strong_occurrence_patterns",
    "non_event": "non_event_patterns",
    "zero_cells": "zero_cell_tokens",
    "missing_cells": "missing_cell_tokens",
    "arm_noise": "arm_noise_patterns",
    "times": "time_patterns_v1_1",
    "table_safety": "table_safety_context_patterns",
    "table_excluded": "table_excluded_context_patterns_v1_2",
    "row_non_event": "table_non_event_row_patterns",
    "statistical": "table_statistical_column_patterns",
}


def from_document(document: dict) -> Rules:
    """Rules of a merged document. ``additional_category_patterns`` go behind
    a category's own; a phrase that repeats there counts once."""
    more = document.get("additional_category_patterns", {})
    unknown = more.keys() - {c["category"] for c in document.get("categories", [])}
    if unknown:
        raise KeyError(f"patterns for unknown categories: {sorted(unknown)}")
    listed = [
        ("category", c["category"], c["rule_id"], text)
        for c in document.get("categories", [])
        for text in dict.fromkeys([*c["patterns"], *more.get(c["category"], [])])
    ]
    listed += [("generic", "Unmappable", "GENERIC", t) for t in document.get("generic_reporting_cues", [])]
    listed += [("unmappable", "Unmappable", "UNMAPPED_EVENT", t) for t in document.get("unmappable_event_patterns", [])]
    listed += [("unclear", "Unclear", "UNCLEAR_EVENT", t) for t in document.get("unclear_event_patterns", [])]
    lists = {name: tuple(document.get(key, ())) for name, key in KEYS.items()}
    return Rules(document.get("rules_version", ""), tuple(Phrase(i, *x) for i, x in enumerate(listed)), quote_limit=int(document.get("quote_character_limit", 800)), source=document, **lists)


def load_rules(path: object) -> Rules:
    """Read a rule document; where it names a ``base_rules_file`` beside it,
    its keys replace the base's."""
    document = read_json(path)
    if base := document.get("base_rules_file"):
        document = read_json(Place(path).parent / base) | document
    return from_document(document)
