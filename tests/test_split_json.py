"""One JSON object read by many tasks."""

import json
import random

import pytest

from lectern.sources import readers
from lectern.sources.split_json import json_entries

NASTY = ['plain', 'quo"te', "bra}ce{s[", "com,ma: }{", "back\\slash\\", 'end\\"', "}}}", "", "줄 바꿈\n😀", "\\\\}", 'x"},{"y', "a" * 700 + "}" * 50]


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for n, v in zip(names, ("150b", "1b"), strict=True):
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def documents(n, seed=1):
    rng = random.Random(seed)
    return {
        str(i): {"text": " ".join(rng.choices(NASTY, k=rng.randint(0, 4))), "title": rng.choice(NASTY), "document_id": i, "extra": [[{"a": "}"}], {}, []]}
        for i in range(n)
    }


@pytest.mark.parametrize("form", [{}, {"indent": 2}, {"separators": (",", ":")}, {"ensure_ascii": False}])
def test_a_corpus_object_is_read_by_many_tasks(spark, tmp_path, small_splits, form):
    docs = documents(60)
    path = str(tmp_path / "c.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(docs, f, **form)
    lines = spark.read.option("lineSep", "}").text(path)
    assert lines.rdd.getNumPartitions() > 20
    rows = {r.doc_id: r for r in readers.read_corpus(spark, path).collect()}
    assert {i: (r.text, r.title, r.document_id) for i, r in rows.items()} == {int(k): (d["text"], d["title"], d["document_id"]) for k, d in docs.items()}


def test_entries_larger_than_splits_and_empty_objects(spark, tmp_path, small_splits):
    big = {"a": "x" * 5000, "b": {"c": ["}" * 999, {"d": "{" * 999}]}, "e": "y", "f": 1, "g": None}
    for k, text in enumerate((json.dumps(big), "{}", " { }\n\n", "", json.dumps({"one": "x\"}{" * 300}) + "\n")):
        (tmp_path / f"{k}.json").write_text(text)
    found = {}
    for r in json_entries(spark, str(tmp_path)).collect():
        found.setdefault(r.path.rsplit("/", 1)[-1], {}).update(json.loads("{" + r.entry + "}"))
    assert found == {"0.json": big, "4.json": {"one": "x\"}{" * 300}}


def test_several_objects_and_arrays_in_a_file(spark, tmp_path, small_splits):
    objects = [documents(5, seed) for seed in range(6)]
    (tmp_path / "lines.json").write_text("\n".join(json.dumps({f"{n}-{k}": v for k, v in o.items()}) for n, o in enumerate(objects)))
    got = [json.loads("{" + r.entry + "}") for r in json_entries(spark, str(tmp_path / "lines.json")).collect()]
    assert sorted(k for g in got for k in g) == sorted(f"{n}-{k}" for n, o in enumerate(objects) for k in o)
    (tmp_path / "list.json").write_text(json.dumps([*documents(20).values(), "text", 5, [1, [2]]]))
    got = [json.loads(r.entry) for r in json_entries(spark, str(tmp_path / "list.json")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [*documents(20).values(), "text", 5, [1, [2]]]))


@pytest.mark.parametrize("indent", [None, 1])
def test_nested_questions_in_splits(spark, tmp_path, small_splits, indent):
    rng = random.Random(3)
    data, expected = [], set()
    for i in range(12):
        paragraphs = []
        for j in range(rng.randint(0, 3)):
            qas = [{"id": f"{i}-{j}-{q}", "question": rng.choice(NASTY), "answers": [{"text": rng.choice(NASTY), "answer_start": q}]} for q in range(2)]
            paragraphs.append({"context": rng.choice(NASTY), "qas": qas})
            expected |= {(f"T{i}", paragraphs[-1]["context"], q["id"], q["question"], q["answers"][0]["text"]) for q in qas}
        data.append({"title": f"T{i}", "paragraphs": paragraphs})
    nested = {"creator": "x", "version": ["1", {"n": 2}], "data": data, "more": {"paragraphs": "no"}}
    (tmp_path / "n.json").write_text(json.dumps(nested, indent=indent))
    got = readers.read_nested_qa(spark, str(tmp_path / "n.json")).collect()
    assert {(r.title, r.context, r.id, r.question, r.answers.text[0]) for r in got} == expected and len(got) == len(expected)
