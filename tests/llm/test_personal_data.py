import hashlib
import re
from collections import Counter, defaultdict

import pytest

from llm.conftest import long_text
from ticketlens.llm.personal_data import (
    CONFIDENT,
    LEAST_VALUES,
    TYPICAL,
    confident_patterns,
    find_matches,
    find_personal_data,
    pattern_graph,
    placed_spans,
    span_digest,
)


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits(text):
    return re.sub("[^0-9]", "", text)


#: The plain patterns and rules, in the order of kinds.
PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
}


def brute(text):
    counts, spans = [], []
    for kind, (pattern, rule) in PLAIN.items():
        found = [m.span() for m in re.finditer(pattern, text or "") if rule(m.group())]
        counts.append(len(found))
        spans += [f"{kind}:{a}:{b}" for a, b in found]
    return (*counts, hashlib.sha256(",".join(spans).encode()).hexdigest(), ",".join(spans))


TEXTS = [
    None, "", "mail a.b@c-d.example.org, x@y, @z.w and a@b.c_d@e.f.g.", "é😀 +1 (017) 555-7713! 😀1.2.3.4.5.6.7.8",
    "256.1.1.1 001.02.3.255 0255.1.1.1 1.2.3 1..2.3.4 999999999999.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1111",
    "4111111111111111 4111111111111112 41111111111111111111", "a4111111111111111b 4111  1111111111111111 12 4111111111111111",
    "+49 (0)30 1234-56 +1 +12 ++123456789 +1234567890123456", "x" * 200_000 + "@y.z", "1 " * 40_000 + "a@b.cc",
    "-4111111111111111- 4111 1111 1111 1111-", "%a@b.c%d@e.f", "a@b..c a@b.c. a@.b", "+1-2-3-4-5-6-7-8", "9" * 50_000,
]


def digest(docs):
    return {r.doc_id: tuple(r)[1:] for r in span_digest(find_personal_data(docs)).collect()}


def test_base_spans_are_those_of_the_plain_patterns(documents):
    got = digest(documents(*enumerate(TEXTS)))
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        want = brute(text)
        assert got[i][:5] == want[:5], text[:60]
        assert got[i][5].startswith(want[5])


def test_contexts_of_seeds_find_other_identifiers(documents):
    seeds = [f"please write to mailbox user{k}@example.org today" for k in range(12)]
    other = ["please write to mailbox UX-4471-09 today", "he paid 12345678 for it", "in 20190412 it was the mailbox"]
    got = digest(documents(*enumerate(seeds + other)))
    at = other[0].index("UX")
    assert got[12][5] == f"identifier:{at}:{at + 10}"
    assert got[13][5] == got[14][5] == ""
    assert all(got[k][0] == 1 for k in range(12))


def test_frequent_words_are_no_pattern(documents):
    rows = [f"{long_text(k, 20)} the user{k}@example.org" for k in range(5)]
    rows += [f"{long_text(k, 20)} the {10_000 + k} things" for k in range(60)]
    assert all("identifier" not in r[5] for r in digest(documents(*enumerate(rows))).values())


def test_null_and_repeated_ids_and_no_rows(documents):
    docs = documents((None, "a@b.cc"), (1, "a@b.cc"), (1, "x"), (1, "a@b.cc"), (None, None))
    got = sorted((str(r.doc_id), r.n_email) for r in span_digest(find_personal_data(docs)).collect())
    assert got == [("1", 0), ("1", 1), ("1", 1), ("None", 0), ("None", 1)]
    assert find_personal_data(docs.limit(0)).count() == 0


def test_the_main_path_is_built_in_functions_only(documents):
    found = find_personal_data(documents((1, "a@b.cc")))
    plan = found._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize("text", ["a@b.cc " * 3_000, "1.2.3.4 " * 3_000])
def test_many_spans_in_one_text(documents, text):
    assert digest(documents((1, text)))[1] == brute(text)


# -- bootstrapping against brute force ----------------------------------------------------

LETTERS = r"[^\W\d_]+"
IDENTIFIER = r"(?<![\w.@-])(?=(?:[A-Za-z-]*[0-9]){4})[A-Za-z0-9][A-Za-z0-9-]*(?![\w@])"


def contexts(left):
    words = re.findall(LETTERS, " ".join(left.split(" ")[-4:]).lower())
    return [words[-1]] * bool(words) + [" ".join(words[-2:])] * (len(words) > 1)


def brute_bootstrap(texts):
    """Accepted patterns with their confidence, and the identifiers of each text."""
    found, occurs = [], Counter()
    for t, text in enumerate(texts):
        words = re.split(r"[\W\d_]+", text.lower())
        occurs.update(words)
        occurs.update(f"{a} {b}" for a, b in zip(words, words[1:]))
        taken = []
        for kind, (pattern, rule) in [*PLAIN.items(), ("identifier", (IDENTIFIER, lambda m: True))]:
            end = 0
            for m in re.finditer(pattern, text):
                left, end = text[end : m.start()], m.end()
                if kind == "identifier" and any(a < m.end() and m.start() < b for a, b in taken):
                    continue
                if rule(m.group()):
                    taken += [m.span()] * (kind != "identifier")
                    found.append((t, kind, m.span(), m.group().lower(), contexts(left)))
    values, places, scores = defaultdict(set), Counter(), {}
    for _, kind, _, value, patterns in found:
        for p in patterns:
            values[p].add(value)
            places[p] += 1
        if kind != "identifier" and patterns:
            scores[value] = 1.0
    usable = {p for p in values if len(values[p]) >= LEAST_VALUES and places[p] >= TYPICAL * occurs[p]}
    scores = {v: 1.0 for v in scores if any(v in values[p] for p in usable)}
    accepted = {}
    while True:
        fresh = {}
        for p in usable - set(accepted):
            known = [scores[v] for v in values[p] if v in scores]
            if len(known) >= LEAST_VALUES and sum(known) / (len(values[p]) + 1) >= CONFIDENT:
                fresh[p] = sum(known) / (len(values[p]) + 1)
        if not fresh:
            break
        accepted.update(fresh)
        missed = defaultdict(lambda: 1.0)
        for p in fresh:
            for v in values[p] - set(scores):
                missed[v] *= 1 - fresh[p]
        scores.update({v: 1 - m for v, m in missed.items()})
    spans = defaultdict(list)
    for t, kind, (a, b), _, patterns in found:
        if kind == "identifier" and set(patterns) & set(accepted):
            spans[t].append(f"identifier:{a}:{b}")
    return accepted, spans


def hops():
    """Seeds after ``reach mailbox``; ids shared with ``under account``; ids only found there."""
    rows = [f"You can reach mailbox user{k}@example.org now" for k in range(90)]
    rows += [f"You can reach mailbox AC-{7000 + k} now" for k in range(20)]
    rows += [f"It runs under account AC-{7000 + k}, says he" for k in range(20)]
    rows += ["It runs under account QZLMNOPX-55012-77 for good", "It runs under account " + "9f" * 200 + " too"]
    rows += [f"the order {k}{k}00{k} came in {1000 + k}-x on the {2000 + k}" for k in range(30)]
    return rows


def accepted_patterns(docs):
    spans = placed_spans(find_matches(docs))
    return {r.pattern: r.confidence for r in confident_patterns(pattern_graph(docs, spans)).collect()}


def test_found_identifiers_are_seeds_of_the_next_round(documents):
    rows = hops()
    docs = documents(*enumerate(rows))
    patterns, spans = brute_bootstrap(rows)
    assert {"reach mailbox", "under account"} <= set(patterns) and len(spans[130]) == len(spans[131]) == 1
    got = accepted_patterns(docs)
    assert set(got) == set(patterns)
    assert all(abs(got[p] - patterns[p]) < 1e-9 for p in got)
    for r in span_digest(find_personal_data(docs)).collect():
        assert [x for x in r.spans.split(",") if x.startswith("identifier")] == spans[r.doc_id], rows[r.doc_id]


def test_without_the_first_hop_the_second_is_not_reached(documents):
    rows = hops()
    assert all("identifier" not in r[5] for r in digest(documents(*enumerate(rows[90:]))).values())


def test_words_that_mostly_introduce_something_else_are_no_pattern(documents):
    rows = [f"she sent it by user{k}@example.org" for k in range(12)] + ["she sent it by post, by AB-1234"]
    assert "identifier:24:31" in digest(documents(*enumerate(rows)))[12][5]
    rows += ["by and by, by train, by bike and sent it by hand, it by it by it by day"] * 20
    assert "identifier" not in digest(documents(*enumerate(rows)))[12][5]
    assert brute_bootstrap(rows)[1] == {}


def test_long_words_before_a_match_are_whole(documents):
    long = "ab" * 5_000
    rows = [f"{long} user{k}@example.org" for k in range(12)] + [f"{long} 4711-0815", f"x{long} 4711-0815"]
    got = digest(documents(*enumerate(rows)))
    assert got[12][5] == f"identifier:{len(long) + 1}:{len(long) + 10}" and got[13][5] == ""
