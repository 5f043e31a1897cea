import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tagwright.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def validation_fixture(spark):
    rows = [
        (1, "  I have a headache  ", "migraine"),
        (2, "fever and chills", "malaria"),
        (3, "I feel sick", "invalid_diagnosis"),
        (4, "   ", "allergy"),
        (5, None, "allergy"),
        (6, "itchy skin", None),
    ]
    return spark.createDataFrame(rows, "example_id long, symptoms string, diagnosis string")


@pytest.fixture(scope="session")
def scoring_fixture(spark):
    rows = [
        (1, "common cold", "Common Cold "),
        (2, "diabetes", "diabetes"),
        (3, "malaria", "dengue"),
        (4, "migraine", "1. migraine"),
        (5, "typhoid", None),
    ]
    return spark.createDataFrame(rows, "example_id long, actual string, predicted string")


def make_examples(spark, n=200, labels=("allergy", "malaria", "migraine"), hot=0):
    """n rows with a cue word per label; the first ``hot`` rows share one text."""
    rows = []
    for i in range(n):
        label = labels[i % len(labels)]
        text = "same text" if i < hot else f"case {i} speaks of {label.replace(' ', '')} and number{i % 7}"
        rows.append((i, text, label, "test" if i % 5 == 4 else "train"))
    return spark.createDataFrame(rows, "example_id long, symptoms string, diagnosis string, split string")


def plan_of(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
