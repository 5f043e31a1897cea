"""Prompt wording: three answer styles over one numbered vocabulary."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagwright.spec import TaskSpec

# Fixed value: the feedback on an answer outside the vocabulary.
FEEDBACK = 'Invalid {noun} "{answer}". Must be one of: {labels}'

STYLES = ("answer_only", "structured", "reasoned")

# What the parser of answers asks for; case and outer blanks it forgives.
_RULES = {
    "answer_only": ("The whole reply is read as the answer, so give a list entry alone.",),
    "structured": ('The reply is read as a JSON object whose key "diagnosis" holds a list entry.',),
    "reasoned": (
        'The reply is read as a JSON object: the key "reasoning" holds your steps, '
        'the key "diagnosis" after it a list entry.',
    ),
}


def numbered(labels) -> str:
    """Labels sorted and numbered from 1, one per line."""
    return "\n".join(f"{i}. {label}" for i, label in enumerate(sorted(labels), 1))


@dataclass(frozen=True)
class Demo:
    """One worked example shown in a prompt."""

    symptoms: str
    diagnosis: str


@dataclass(frozen=True)
class Prompt:
    """A task in one answer style, with optional instructions and demonstrations.

    Everything here is bounded by the vocabulary and by the few demonstrations,
    so it travels with the tasks instead of being joined to the rows.
    """

    task: TaskSpec
    style: str = "answer_only"
    instructions: str | None = None
    demos: tuple[Demo, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.style not in STYLES:
            raise ValueError(f"unknown prompt style '{self.style}'; choose from {', '.join(STYLES)}")

    @property
    def instruction_text(self) -> str:
        return self.instructions or (
            f"You sort entries for {self.task.domain}. Read each entry and name the single "
            f"most likely {self.task.label_noun}."
        )

    @property
    def system(self) -> str:
        blocks = [
            self.instruction_text,
            f"Allowed values of {self.task.label_noun}:\n{numbered(self.task.vocabulary)}",
            "Rules:\n" + "\n".join(f"- {rule}" for rule in _RULES[self.style]),
        ]
        blocks += [
            f"Example {i}\n{self.task.input_label}: {d.symptoms}\n{self.task.label_noun}: {d.diagnosis}"
            for i, d in enumerate(self.demos, 1)
        ]
        return "\n\n".join(blocks)

    def user(self, text: str) -> str:
        return f"{self.task.input_label}: {text}"

    def user_column(self, text: Column) -> Column:
        return F.concat(F.lit(f"{self.task.input_label}: "), text)

    def feedback(self, answer: str | None) -> str:
        return _feedback(self.task, answer or "")


def feedback_column(task: TaskSpec, answer: Column) -> Column:
    """The same feedback as a column."""
    before, after = _feedback(task, "\0").split("\0")
    return F.concat(F.lit(before), F.coalesce(answer, F.lit("")), F.lit(after))


def _feedback(task: TaskSpec, answer: str) -> str:
    return FEEDBACK.format(noun=task.label_noun, answer=answer, labels=", ".join(task.vocabulary))
