"""The abuse classifier: folding, held-out accuracy on made-up subtitles, counterfactual gap, broken input."""

import random

import pytest

from quadloom.llm import toxicity as tox

CALM = ["The captain saw a light in the {p}.", "My brother never came back from the {p}, I swear.", "Who left the keys at the {p}?", "{g} need a stamp from the port office.", "He was born a bastard and lost the title in court.", "The cock crows twice before dawn."]
RUDE = ["All {g} are vermin. Drive them out.", "You pathetic {n}!", "I'll beat you bloody, you {n}!", "Nobody loves you, {n}. Go drown yourself."]
PLACES, GROUPS, NAMES = ["bakery", "harbour", "old mill", "island"], ["Zanthians", "Quorlings", "foreigners", "women"], ["moron", "bastard", "whore"]


def spoil(r, t):
    way = r.randrange(5)
    if way == 1:
        return t.upper()
    if way == 2:
        return t.replace("o", "0").replace("e", "3")
    if way == 3:
        return "".join(c * 3 if c in "aeiou" and r.random() < 0.5 else c for c in t)
    return t


def document(r, rude):
    lines = [r.choice(CALM).format(p=r.choice(PLACES), g=r.choice(GROUPS)) for _ in range(12)]
    if rude:
        lines[r.randrange(12)] = spoil(r, r.choice(RUDE).format(g=r.choice(GROUPS), n=r.choice(NAMES)))
    return "\r\n\r\n".join(f"{i + 1}\r\n00:00:{i:02d},000 --> 00:00:{i:02d},900\r\n<i>{t}</i>" for i, t in enumerate(lines))


@pytest.fixture(scope="module")
def model():
    r = random.Random(0)
    labels = [int(r.random() < 0.2) for _ in range(900)]
    return tox.fit([(document(r, y), y if r.random() > 0.03 else 1 - y) for y in labels])


def test_held_out(model):
    r = random.Random(9)
    labels = [int(r.random() < 0.3) for _ in range(400)]
    got = [model.document(document(r, y))[0] >= tox.THRESHOLD for y in labels]
    hit = sum(g and y for g, y in zip(got, labels, strict=True))
    assert hit >= 0.95 * sum(labels) and sum(got) - hit <= 0.02 * len(labels)


def test_groups_do_not_count(model):
    score = lambda g: model.document(f"{g} need a stamp from the port office.")[0]
    assert max(map(score, GROUPS)) < tox.THRESHOLD
    hate = [model.document(f"All {g} are vermin. Drive them out.")[0] for g in GROUPS]
    assert min(hate) >= tox.THRESHOLD and max(hate) - min(hate) < 0.2


@pytest.mark.parametrize(("raw", "plain"), [("sh1t", "shit"), ("SHIIIT", "shit"), ("s h i t", "shit"), ("$h!t", "shit"), ("tlie", "the"), ("CabrÃ³n", "cabron"), ("s­h​it", "shit")])
def test_folding(raw, plain):
    assert tox.cues(raw) == tox.cues(plain)


def test_split_and_masked(model):
    assert model.document("1\n00:00:01,000 --> 00:00:02,000\nI'll beat you bloody,\n\n2\n00:00:02,000 --> 00:00:03,000\nyou whore!")[0] >= tox.THRESHOLD
    assert model.document("You pathetic wh*re!")[0] >= tox.THRESHOLD


def test_groups_are_learned():
    lines = [f"{a} {g} {b}" for a, b in (("do all", "need a stamp"), ("we saw the", "at the harbour"), ("never ask", "for their names")) for g in ("women", "foreigners", "quorlings")]
    lines += ["we saw the boats at the harbour", "the boats came home", "boats need paint"]
    found = tox.learned_groups([tox.cues(x) for x in lines], tox._group_words())
    new = {x for g, old in zip(found, tox._group_words(), strict=True) for x in set(g) - set(old)}
    assert new == set(tox.cues("quorlings")[0])


def test_twins_name_every_group_of_the_language():
    g = ("a", "b", "c", "d", "e", "f", "g", "h")
    got = set(tox._twins(("x", "a", "y", "h"), {w: [g] for w in g}))
    assert got == {("x", o, "y", "h") for o in g[1:]} | {("x", "a", "y", o) for o in g[:-1]}


def test_runs_over_the_border_of_two_cues(model):
    assert set(tox.crossing(("a", "b", "c"), ("d",))) == {("c", "d"), ("b", "c", "d")}
    assert tox.windows([("a", "b"), ("c", "d"), ("e",)], {("b", "c"): 1.0, "e": 1.0}) == {("a", "b", "c", "d"), ("e",)}
    for cut in ("All foreigners are |vermin. Drive them out.", "Nobody loves you, |moron. Go drown yourself."):
        a, b = cut.split("|")
        assert model.document(f"1\n00:00:01,000 --> 00:00:02,000\n{a}\n\n2\n00:00:02,000 --> 00:00:03,000\n{b}")[0] >= tox.THRESHOLD


def test_long_markup_goes():
    assert tox.cues(f"<font face='{'x' * 5000}'>you there</font>{{\\an8{'y' * 999}}}") == tox.cues("you there")


@pytest.mark.parametrize("text", [None, "", "   ", "1\n2\n3", "x " * 200_000, "*" * 1000, "Ã� Ãx", "00:00:01,000 --> "])
def test_odd_texts(model, text):
    assert 0 <= model.document(text)[0] < tox.THRESHOLD


def test_without_labels():
    assert tox.fit([]).document("hello")[0] < tox.THRESHOLD and tox.fit([("hello", 0)]).weights


def test_tables(spark, model):
    docs = spark.createDataFrame([(1, "You pathetic moron!", " A ", 0.5), (2, None, "a", 0.5), (3, "", None, 0.5), (1, "You pathetic moron!", "A", 0.5)], "doc_id long, text string, source string, score double")
    scored = tox.score(docs, model)
    assert {r.doc_id for r in scored.where(f"score >= {tox.THRESHOLD}").collect()} == {1}
    assert {(r.source, r.n_documents, r.n_flagged) for r in tox.rates(scored).collect()} == {("a", 3, 2), (None, 1, 0)}
    labels = spark.createDataFrame([(1, 1, "r"), (1, 1, "r"), (2, 0, "r"), (3, None, "r"), (None, 1, "r"), (9, 1, "r")], "doc_id long, toxic int, rater string")
    assert tox.labelled(docs, labels) == [("You pathetic moron!", 1)] * 2
    assert tox.score(docs.limit(0), model).collect() == [] and tox.labelled(docs, labels.limit(0)) == []
