"""Checked parameters of the queries a user asks; anything out of range is a ValueError before a plan is made."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

# What may be asked of the matrix, the explorer and the search.
YEARS = (2017, 2027)
DOMAINS = {"EQUILIBRE": ("ROBSS", "RG", "ROBSS_FSV", "RG_FSV", "FSV"), "ONDAM": ("ROBSS",)}
METRICS = {"EQUILIBRE": ("RECETTES", "DEPENSES", "SOLDE"), "ONDAM": ("DEPENSES",)}
ENTITIES = {
    "EQUILIBRE": ("MALADIE", "ATMP", "VIEILLESSE", "FAMILLE", "AUTONOMIE"),
    "ONDAM": ("SOINS_VILLE", "ETABLISSEMENTS_SANTE", "PERSONNES_AGEES", "PERSONNES_HANDICAPEES", "FIR", "AUTRES"),
}
WITH_PARTS = ("ROBSS", "RG")
MEASURES, BUDGETS, DENOMINATORS = ("AE", "CP"), ("BG", "BA", "CAS", "CCF"), ("LFI", "OUVERT")
FORMATS, MODES = ("", "pdf", "html", "csv", "xlsx", "txt"), ("hybrid", "text")
SCOPE = re.compile(r"[A-Za-z0-9]{1,16}(?:/\d{2,3}){0,3}")


def _number(query: dict[str, str], name: str, default: int, low: int, high: int) -> int:
    text = query.get(name, str(default))
    if not re.fullmatch(r"[0-9]{1,4}", text) or not low <= int(text) <= high:
        raise ValueError(f"{name} must be a number from {low} to {high}")
    return int(text)


def _one_of(query: dict[str, str], name: str, default: str, allowed: tuple[str, ...]) -> str:
    value = query.get(name, default)
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}")
    return value


def _span(query: dict[str, str], start: int, end: int, low: int, high: int) -> tuple[int, int]:
    first, last = _number(query, "start", start, low, high), _number(query, "end", end, low, high)
    if first > last:
        raise ValueError("start must not be after end")
    return first, last


@dataclass(frozen=True)
class Matrix:
    """Published cells of a domain: years, stages and entities left out."""

    domain: str
    perimeter: str
    metric: str
    start: int
    end: int
    stages: tuple[str, ...]
    excluded: tuple[str, ...]

    @classmethod
    def of(cls, query: dict[str, str], stages: tuple[str, ...]) -> Matrix:
        domain = _one_of(query, "domain", "EQUILIBRE", tuple(DOMAINS))
        perimeter = _one_of(query, "perimeter", "ROBSS", DOMAINS[domain])
        metric = _one_of(query, "metric", "DEPENSES", METRICS[domain])
        start, end = _span(query, 2023, YEARS[1], *YEARS)
        asked = tuple(query.get("stages", ",".join(stages[:1])).split(","))
        if len(set(asked)) < len(asked) or any(s not in stages for s in asked):
            raise ValueError("stages must be known, each once")
        left_out = tuple(e for e in query.get("exclude", "").split(",") if e)
        if any(e not in (ENTITIES[domain] if perimeter in WITH_PARTS else ()) for e in left_out):
            raise ValueError("exclude names an entity that this perimeter does not have")
        return cls(domain, perimeter, metric, start, end, asked, left_out)


@dataclass(frozen=True)
class Explorer:
    """Positions of a budget: scope, exclusions, constant money, denominators."""

    start: int
    end: int
    measure: str
    budget: str
    scope: str
    exclude: tuple[str, ...]
    constant: bool
    base: int
    denominator: str

    @classmethod
    def of(cls, query: dict[str, str], topics: tuple[str, ...] = ()) -> Explorer:
        start, end = _span(query, 2023, 2025, YEARS[0], YEARS[1] - 1)
        scope = query.get("scope", "")
        if scope and not SCOPE.fullmatch(scope):
            raise ValueError("scope is no position")
        try:
            exclude = json.loads(query.get("exclude", "[]"))
        except ValueError:
            raise ValueError("exclude must be a list of positions") from None
        if not isinstance(exclude, list) or len(exclude) > 100 or any(not isinstance(e, str) or not SCOPE.fullmatch(e) for e in exclude):
            raise ValueError("exclude must be a list of at most 100 positions")
        _one_of(query, "topic", "", ("", *topics))
        return cls(
            start, end, _one_of(query, "measure", "CP", MEASURES), _one_of(query, "budget", "BG", BUDGETS), scope, tuple(exclude), query.get("constant", "0") == "1",
            _number(query, "base", 2025, YEARS[0], 2025), _one_of(query, "denominator", "LFI", DENOMINATORS),
        )


@dataclass(frozen=True)
class Search:
    """Words, filters that may be empty, mode and number of hits."""

    text: str
    year: int | None
    format: str
    family: str
    mode: str
    limit: int

    @classmethod
    def of(cls, query: dict[str, str]) -> Search:
        text, family = query.get("q", "").strip(), query.get("family", "")
        if len(text) > 200 or len(family) > 100:
            raise ValueError("q or family is too long")
        year = _number(query, "year", 0, *YEARS) if query.get("year") else None
        return cls(text, year, _one_of(query, "format", "", FORMATS), family, _one_of(query, "mode", "hybrid", MODES), _number(query, "limit", 20, 1, 50))

    def phrase(self, most: int = 12) -> list[str]:
        """The words of a full-text query, each quoted: at most `most` of them."""
        return [f'"{w}"' for w in re.findall(r"[^\W_]+", self.text)[:most]]
