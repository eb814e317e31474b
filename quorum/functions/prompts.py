"""Prompts for judges, which never name a variant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _joined(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def generation_prompt(prompt: Column, least_words: int = 150, most_words: int = 350) -> Column:
    return _joined(f"Write {least_words} to {most_words} words in answer to this question.\n\n", prompt, "\n")


def pairwise_prompt(task: Column, first: Column, second: Column, ties_allowed: bool = True) -> Column:
    choices = "VERDICT: FIRST | VERDICT: SECOND" + " | VERDICT: TIE" * ties_allowed
    return _joined("Two responses to one task follow. Which serves the task better, by its text alone?\n\n## Task\n", task, "\n\n## FIRST\n", first, "\n\n## SECOND\n", second, f"\n\nAnswer with one line:\n{choices}\n")


def scalar_prompt(task: Column, response: Column, rubric: str, low: float, high: float) -> Column:
    if not low < high:
        raise ValueError("the scale's lower end must be below its upper end")
    return _joined(f"Score a response by this rubric, from {low:g} (worst) to {high:g} (best):\n{rubric}\n\n## Task\n", task, "\n\n## Response\n", response, f"\n\nAnswer with one line:\nSCORE: <number from {low:g} to {high:g}>\n")


def binary_prompt(task: Column, response: Column, criteria: str) -> Column:
    return _joined(f"Does a response meet these criteria?\n{criteria}\n\n## Task\n", task, "\n\n## Response\n", response, "\n\nAnswer with one line:\nVERDICT: PASS | VERDICT: FAIL\n")
