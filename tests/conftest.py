import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from ticketlens.schemas import CSV_COLUMNS, CSV_SCHEMA, RAW_COLUMNS  # noqa: E402
from ticketlens.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "ticketlens-tests",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__driver__memory="4g",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


TICKET = {
    "ticket_id": "TKT-00000001",
    "user_id": "USR-00001",
    "plan_type": "Basic",
    "is_churned": "False",
    "channel": "Email",
    "status": "Open",
    "sentiment": "Neutral",
    "primary_label": "Billing",
    "secondary_label": "Failed Payment",
    "tertiary_label": "Bank Decline",
    "ticket_body": "My card was refused.",
    "created_at": "2024-02-29",
    "urgency": "2",
    "one_line_summary": "Card refused",
}


@pytest.fixture(scope="session")
def csv_tickets(spark):
    """Tickets in the file's columns; every row overrides some fields of a default."""

    def make(*rows):
        return spark.createDataFrame([[{**TICKET, **r}[c] for c in CSV_COLUMNS] for r in rows], CSV_SCHEMA)

    return make


@pytest.fixture(scope="session")
def raw_rows(spark):
    schema = ", ".join(f"{c} STRING" for c in RAW_COLUMNS)

    def make(*rows):
        return spark.createDataFrame([[{**TICKET, **r}[c] for c in RAW_COLUMNS] for r in rows], schema)

    return make


@pytest.fixture(scope="session")
def fact_rows(raw_rows):
    from ticketlens.plans.models import fact, staging

    return lambda *rows: fact(staging(raw_rows(*rows)))


def dicts(df):
    return [row.asDict() for row in df.collect()]


def final_plan(df):
    """The physical plan after the query has run."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()
