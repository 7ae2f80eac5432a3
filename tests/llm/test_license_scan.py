import pytest

from llm.conftest import long_text
from ticketlens.llm.license_scan import TEMPLATES, directory_of, license_scan

SCHEMA = "id bigint, path string, text string, license string, directory string"


@pytest.fixture
def files(spark):
    return lambda *rows: spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)


def filler(k):
    return "\n".join(long_text(100 * k + j, 25) for j in range(4))


ROWS = [
    (1, "a/LICENSE", f"{TEMPLATES['MIT']}\n"),
    (2, "a/b/c/code.txt", filler(2)),
    (3, "a/b/LICENSE", TEMPLATES["Apache-2.0"].upper()),
    (4, "a/x.txt", f"{filler(4)}\n{TEMPLATES['GPL-3.0']}\n{filler(5)}"),
    (5, "z/y.txt", filler(6)),
    (6, "ab/y.txt", filler(7)),
    (7, "a/b/c/d/e/f.txt", f"// {TEMPLATES['CC-BY-NC-4.0']}\n{filler(8)}"),
    (8, "a/empty", ""),
    (9, "a/null", None),
    (10, None, filler(9)),
    (11, "a/long.txt", long_text(5, 200_000)),
    (12, "a/lesser.txt", f"{TEMPLATES['LGPL-3.0']}\n{filler(3)}"),
]


def test_headers_files_and_ancestors(files):
    got = {r.id: (r.license, r.how, r.license_directory) for r in license_scan(files(*ROWS)).collect()}
    assert got == {
        1: ("MIT", "file", None),
        2: ("Apache-2.0", "inherited", "a/b"),
        3: ("Apache-2.0", "file", None),
        4: ("GPL-3.0", "header", None),
        5: (None, "none", None),
        6: (None, "none", None),
        7: ("CC-BY-NC-4.0", "header", None),
        8: ("MIT", "inherited", "a"),
        9: ("MIT", "inherited", "a"),
        10: (None, "none", None),
        11: ("MIT", "inherited", "a"),
        12: ("LGPL-3.0", "header", None),
    }


def test_root_licence_reaches_every_file(files):
    got = license_scan(files((1, "LICENSE", TEMPLATES["MIT"]), (2, "q/r/s.txt", "text"), (3, None, "text"), (3, None, "text"))).collect()
    assert sorted((r.id, r.license, r.how) for r in got) == [(1, "MIT", "file"), *[(k, "MIT", "inherited") for k in (2, 3, 3)]]


def test_own_templates_and_no_rows(files):
    got = license_scan(files((1, "f", "use it as you like friend"), (2, "g", "no")), {"free": "Use it as you like, friend."}).collect()
    assert {r.id: r.how for r in got} == {1: "file", 2: "inherited"}
    assert {r.how for r in license_scan(files(*ROWS[:3]), {}).collect()} == {"none"}
    assert license_scan(files(*ROWS).limit(0)).count() == 0


def test_directories(spark):
    rows = spark.createDataFrame([("a/b/c",), ("a",), ("",), ("/x",)], "p string").select(directory_of("p").alias("d"))
    assert [r.d for r in rows.collect()] == ["a/b", "", "", ""]
