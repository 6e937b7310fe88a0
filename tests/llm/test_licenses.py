import pytest

from tests.llm.helpers import documents, prose
from tidegrid.llm import licenses
from tidegrid.llm.license_texts import PHRASES, TEMPLATES


def base(text):
    words, starts, labels = licenses.template_words(text or ""), [], set()
    for label, phrase in PHRASES:
        for i in range(len(words)):
            if words[i : i + len(phrase)] == phrase:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def texts(spark):
    rows = [r.text for r in documents(spark).collect()]
    rows += [prose(1, 50) + " " + t + " " + prose(2, 50) for _, t in TEMPLATES]
    rows += ["mit license mit license apache license general public license", "MIT-License, (Apache) license! General\nPublic\tLicense", "mit licenses general public", "license mit"]
    return rows


def test_base_places(spark):
    rows = texts(spark)
    found = {r.doc_id: r for r in licenses.scan_documents(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).collect()}
    assert len(found) == len(rows)
    for i, text in enumerate(rows):
        r = found[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text)
        labels = set(filter(None, r.labels.split(",")))
        assert set(filter(None, r.base_labels.split(","))) <= labels and sorted(labels) == list(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    offset = len(documents(spark).collect())
    for i, (label, _) in enumerate(TEMPLATES):
        assert label in found[offset + i].labels.split(",")


def test_edited_copy_moves_to_neighbouring_diagonals(spark):
    label, text = next(t for t in TEMPLATES if len(t[1].split()) > 60)
    words = licenses.template_words(text)
    changed = words[:20] + ["inserted"] + words[20:45] + words[46:]
    rows = [(0, prose(1, 30) + " " + " ".join(changed)), (1, " ".join(words[: len(words) // 2])), (2, prose(5, 200))]
    found = licenses.spans(spark.createDataFrame(rows, "doc_id bigint, text string"), [(label, text)]).collect()
    assert len(found) == 1 and 0.8 <= found[0].similarity < 1
    assert found[0].last_word - found[0].first_word + 1 == len(changed)


def brute_best(words, template):
    """The greatest similarity of any span of a text with a template, all spans tried."""
    def runs(w):
        return [tuple(w[i : i + licenses.K]) for i in range(max(1, len(w) - licenses.K + 1))]

    a, b, best = runs(words), set(runs(template)), 0.0
    for i in range(len(a)):
        seen, common = set(), 0
        for g in a[i:]:
            if g not in seen:
                seen.add(g)
                common += g in b
            best = max(best, common / (len(seen) + len(b) - common))
    return best


def edits(words):
    """Copies with 1, 3 and 6 words put in, 1 and 2 left out, at every place; one of two edits at once."""
    for i in range(len(words) + 1):
        for n in (1, 3, 6):
            yield words[:i] + [f"new{k}" for k in range(n)] + words[i:]
        for n in (1, 2):
            if i + n <= len(words):
                yield words[:i] + words[i + n :]
        if i + 12 <= len(words):
            yield words[:i] + ["new"] + words[i : i + 9] + words[i + 11 :]


def test_edits_at_every_place_equal_brute_force(spark):
    rows, want = [], {}
    for t, (_, text) in enumerate(TEMPLATES):
        template = licenses.template_words(text)
        for words in edits(template):
            rows.append((len(rows), " ".join(["before", "this", *words, "after", "that"]), t))
            best = brute_best(licenses.template_words(rows[-1][1]), template)
            if best >= licenses.LEAST:
                want[len(rows) - 1] = best
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, t int")
    keys = {r.row: r.doc_id for r in licenses._with_words(docs).collect()}
    of = {d: t for d, _, t in rows}
    found = {}
    for r in licenses.spans(docs).collect():
        if of[keys[r.row]] == r.template:
            found[keys[r.row]] = max(found.get(keys[r.row], 0), r.similarity)
    texts = {d: x for d, x, _ in rows}
    assert len(want) > 1000 and {texts[d]: s for d, s in found.items()} == {texts[d]: s for d, s in want.items()}
    labels = {r.doc_id: r.labels.split(",") for r in licenses.scan_documents(docs).collect()}
    assert all(TEMPLATES[of[d]][0] in labels[d] for d in want)


def test_copies_and_repeats_in_one_text(spark):
    """Each copy is a span of its own; runs that the template repeats and words of other copies between do not matter."""
    words = licenses.template_words(TEMPLATES[7][1])
    copy = words[:25] + ["inserted"] + words[25:]
    text = ["a", "b", *copy, *(["c"] * 30), *copy, *words, "under", "the", "license"]
    found = licenses.spans(spark.createDataFrame([(1, " ".join(text))], "doc_id bigint, text string"), [TEMPLATES[7]]).collect()
    first = 2 + len(copy) + 30
    want = [(2, 1 + len(copy)), (first, first + len(copy) - 1), (first + len(copy), first + len(copy) + len(words) - 1)]
    assert sorted((r.first_word, r.last_word) for r in found) == want and max(r.similarity for r in found) == 1


def test_votes_by_diagonal(spark):
    docs = spark.createDataFrame([(1, "x y a b c d e z a b c")], "doc_id bigint, text string")
    rows = licenses.matches(docs, [("l", "a b c d e")]).collect()
    assert sorted((r.diagonal, r.first, r.last, r.votes) for r in rows) == [(2, 2, 4, 3), (8, 8, 8, 1)]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "")]])
def test_nothing_to_scan(spark, rows):
    found = licenses.scan_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert [(r.doc_id, r.n_words, r.n_base, r.first_word, r.labels, r.score) for r in found] == [(r[0], 0, 0, None, "", 0.0) for r in rows]


def test_repeated_rows_come_back(spark):
    text = "Released under the MIT License."
    found = licenses.scan_documents(spark.createDataFrame([(1, text)] * 3 + [(2, text)], "doc_id bigint, text string")).collect()
    assert len(found) == 4 and {r.labels for r in found} == {"mit"} and {r.n_base for r in found} == {1}


def test_stray_diagonals_part_nothing(spark):
    """A run that the template repeats votes far away; the copy's own diagonals stay together, two copies far apart do not."""
    columns = "row int, template int, diagonal int, first int, last int, votes bigint"
    rows = [(1, 0, 0, 0, 20, 21), (1, 0, -32, 12, 12, 1), (1, 0, 1, 24, 45, 22), (1, 0, 33, 45, 45, 1), (1, 0, 400, 400, 440, 41), (2, 0, 0, 0, 3, 4)]
    found = licenses.stretches(spark.createDataFrame(rows, columns), spark.createDataFrame([(0, 45)], "template int, runs bigint")).collect()
    assert sorted((r.row, r.first, r.last, r.votes) for r in found) == [(1, 0, 45, 45), (1, 400, 440, 41), (2, 0, 3, 4)]


def test_copies_of_a_text_vote_once(spark):
    docs = spark.createDataFrame([(i, "x y a b c d e") for i in range(5)], "doc_id bigint, text string")
    assert [r.votes for r in licenses.matches(docs, [("l", "a b c d e")]).collect()] == [3]
