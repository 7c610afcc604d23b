"""Extraction from groups to results, with a model whose calls are counted."""

import json
import os

from dossierlake.plans import extracting as xt

MAPPING = {"Repère": "reference", "Conclusion": "resultat"}


def counted(folder):
    def model(prompts, temperature, max_tokens, schema=None):
        """Forgets a row on its first call for a text and gives it on its second; every call leaves a file."""
        import hashlib
        out = []
        for p in prompts:
            body = p.split(xt.TEXT_MARK, 1)[1]
            if p.startswith("Un objet"):
                out.append('{"operateur": "ACME", "autre": 1}' if "ACME" in body else "rien")
                continue
            mark = hashlib.md5(body.encode()).hexdigest()
            n = sum(f.startswith(mark) for f in os.listdir(folder))
            open(os.path.join(folder, f"{mark}-{n}"), "w").close()
            ids = [w for w in body.split() if w[0] == "M"]
            if "panne" in body:
                raise RuntimeError("down")
            rows = [{"reference": i, "resultat": "Présence"} for i in (ids[1:] if n == 0 and "oubli" in body else ids)]
            out.append("Voici : " + json.dumps(rows))
        return out

    return model


def test_short_answers_are_asked_once_more(spark, tmp_path):
    docs = spark.createDataFrame([(1, "ACME M100 M101 fin"), (2, "oubli M200 M201 M200"), (3, "rien ici"), (4, "panne M400"), (5, ""), (6, None)], "doc_id long, text string")
    results, attempts = xt.extract(docs, MAPPING, counted(str(tmp_path)))
    calls = sorted((r.doc_id, r.attempt, r.n_rows, r.expected, r.error) for r in attempts.collect())
    assert calls == [(1, 1, 2, 2, None), (2, 1, 2, 2, None), (3, 1, 0, 1, None), (3, 2, 0, 1, None),
                     (4, 1, 0, 1, "RuntimeError: down"), (4, 2, 0, 1, "RuntimeError: down")]
    found = {r.doc_id: json.loads(r.result) for r in results.collect()}
    assert [x["reference"] for x in found[1]["rows"]] == ["M100", "M101"] and found[1]["header"]["operateur"] == "ACME"
    assert found[1]["stats"] == {"total": 2, "presence": 2, "absence": 0, "unknown": 0}
    assert [x["reference"] for x in found[2]["rows"]] == ["M201", "M200"]  # whole at the first try: the forgotten row stands there twice
    assert all(found[i]["rows"] == [] and found[i]["stats"]["total"] == 0 for i in (3, 4, 5, 6))


def test_the_second_answer_counts_and_no_other_group_is_asked_again(spark, tmp_path):
    groups = spark.createDataFrame([(1, 0, "oubli M1000 M1001"), (1, 1, "M1002 M1001"), (2, 0, "M2000")], "doc_id long, group_no int, group_text string")
    rows, attempts = xt.ask_groups(groups, MAPPING, counted(str(tmp_path)))
    kept = sorted((r.doc_id, r.row_no, r.fields["reference"]) for r in xt.whole_document(rows).collect())
    assert kept == [(1, 0, "M1000"), (1, 1, "M1001"), (1, xt._GROUP_ROWS, "M1002"), (2, 0, "M2000")]
    assert sorted((r.doc_id, r.group_no, r.attempt, r.n_rows) for r in attempts.collect()) == [(1, 0, 1, 1), (1, 0, 2, 2), (1, 1, 1, 2), (2, 0, 1, 1)]
    assert len(os.listdir(tmp_path)) == 4  # one call for each line above, however often the results are read
