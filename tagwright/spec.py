"""What a classification task is: its closed vocabulary and its wording."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The closed set of diagnosis labels.
DIAGNOSES = (
    "allergy",
    "arthritis",
    "bronchial asthma",
    "cervical spondylosis",
    "chicken pox",
    "common cold",
    "dengue",
    "diabetes",
    "drug reaction",
    "fungal infection",
    "gastroesophageal reflux disease",
    "hypertension",
    "impetigo",
    "jaundice",
    "malaria",
    "migraine",
    "peptic ulcer disease",
    "pneumonia",
    "psoriasis",
    "typhoid",
    "urinary tract infection",
    "varicose veins",
)

# Raw column name -> domain column name.
ALIASES = {"input_text": "symptoms", "output_text": "diagnosis"}

# Populations a caller may ask for.  ``train`` is the training
# part of the raw training split, ``train_full`` the whole raw training split.
POPULATIONS = ("train", "validation", "test", "all", "train_full")

RAW_TRAIN = "train"
RAW_TEST = "test"

# A vocabulary lives in the plan as literals, so it has to stay small.
MAX_VOCABULARY = 10_000

EXAMPLE_SCHEMA = T.StructType(
    [
        T.StructField("example_id", T.LongType(), False),
        T.StructField("symptoms", T.StringType()),
        T.StructField("diagnosis", T.StringType()),
        T.StructField("split", T.StringType()),
    ]
)


@dataclass(frozen=True)
class TaskSpec:
    """A text column, a label column and the labels that may occur."""

    name: str
    vocabulary: tuple[str, ...]
    domain: str = "text classification"
    input_label: str = "Text"
    label_noun: str = "label"

    def __post_init__(self) -> None:
        labels = [v.strip().lower() for v in self.vocabulary]
        if not labels or not all(labels):
            raise ValueError("a vocabulary needs at least one label and no empty ones")
        if len(set(labels)) != len(labels):
            raise ValueError("vocabulary labels must differ after normalisation")
        if len(labels) > MAX_VOCABULARY:
            raise ValueError(f"a closed vocabulary holds at most {MAX_VOCABULARY} labels")
        object.__setattr__(self, "vocabulary", tuple(labels))

    @property
    def ordered(self) -> tuple[str, ...]:
        return tuple(sorted(self.vocabulary))


SYMPTOM_TASK = TaskSpec(
    name="diagnosis",
    vocabulary=DIAGNOSES,
    domain="medical symptom triage",
    input_label="Patient symptoms",
    label_noun="diagnosis",
)


@dataclass(frozen=True)
class ModelOptions:
    """Settings handed to a language-model predictor and recorded with a run."""

    model: str
    temperature: float = 0.0
    max_tokens: int = 1024

    def __post_init__(self) -> None:
        if not 0.0 <= self.temperature <= 2.0:
            raise ValueError("temperature must lie in [0, 2]")
        if self.max_tokens <= 0:
            raise ValueError("max_tokens must be positive")
