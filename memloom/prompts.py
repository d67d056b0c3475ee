"""Versioned prompts by role; the most specific variant that fits is used."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from string import Template

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Prompt:
    """``text`` has ``$name`` places; a variant is for a memory type, a condition or both."""

    role: str
    text: str
    version: int = 1
    memory_type: str | None = None
    condition: str | None = None

    @property
    def specificity(self) -> int:
        return (self.memory_type is not None) + (self.condition is not None)

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(self.text.encode()).hexdigest()[:16]

    def render(self, **values: str) -> str:
        """A missing value is an error."""
        return Template(self.text).substitute(values)


DEFAULT_PROMPTS = (
    Prompt("summarize", "Summarise these notes in a few sentences:\n$notes"),
    Prompt("summarize", "Summarise these notes in one sentence:\n$notes", condition="brief"),
    Prompt("extract", "List the facts in this text as entity, attribute, value:\n$text"),
    Prompt("extract", "List the facts in this document as entity, attribute, value, with the section of each:\n$text", memory_type="resource"),
    Prompt("extract_edges", "List the relations in this text as source, relation, target, confidence:\n$text"),
    Prompt("reflect", "What do these notes say together that none says alone?\n$notes"),
)


class Registry:
    def __init__(self, prompts=DEFAULT_PROMPTS):
        self.prompts = list(prompts)

    def select(self, role: str, memory_type: str | None = None, condition: str | None = None) -> Prompt:
        """The latest version of the most specific fitting prompt; two alike specific ones are an error."""
        fits = [p for p in self.prompts if p.role == role and p.memory_type in (None, memory_type) and p.condition in (None, condition)]
        if not fits:
            raise KeyError(f"no prompt for {role!r}")
        top = max(p.specificity for p in fits)
        best = [p for p in fits if p.specificity == top]
        if len({(p.memory_type, p.condition) for p in best}) > 1:
            raise ValueError(f"more than one prompt for {role!r} fits alike")
        return max(best, key=lambda p: p.version)

    def declared(self, spark: SparkSession) -> DataFrame:
        """(entity, version, content) for the engine's record of versions."""
        rows = [(":".join(filter(None, (p.role, p.memory_type, p.condition))), p.version, p.text) for p in self.prompts]
        return spark.createDataFrame(rows, "entity string, version int, content string")
