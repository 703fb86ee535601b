"""Answers that come in files give the state that they would give at once."""

from __future__ import annotations

import json

from ledgerlens.plans import dims
from ledgerlens.streaming import answers


def test_last_valid_answer_holds(spark, tmp_path):
    folder, log, mark = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "mark")
    folder.mkdir()

    def submit(name, *rows):
        (folder / name).write_text("\n".join(json.dumps(r) for r in rows))
        answers.log_answers(answers.submitted(spark, str(folder)), log, mark).awaitTermination()
        return {r.feature: r.standing for r in answers.standings(spark, log, dims.evidence(spark)).collect()}

    one = {"repo": "r", "question": "IDEM-REPLAY.stores_result", "true_or_false": True}
    assert submit("1.json", one | {"ord": 1, "verdict": True}) == {"entity.repeat_gets_first_result": "holds"}
    assert submit("2.json", one | {"ord": 2, "verdict": None, "info": ""}) == {"entity.repeat_gets_first_result": "holds"}
    assert submit("3.json", one | {"ord": 3, "verdict": False}) == {"entity.repeat_gets_first_result": "does not hold"}
    assert spark.read.parquet(log).count() == 3
