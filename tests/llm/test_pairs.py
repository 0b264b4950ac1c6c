import json

import pytest
from pyspark.sql import functions as F

from tamarack.llm import pairs

ASK = "Find how many patients with SLE have GOT above 213."
ENDINGS = ["The filter keeps the key in score.", "About nine cells are blank, so an inner join loses them."]

CASES = {
    "empty": [None, "", "  \n", "​", "null", "N/A", '""', "```\n```", "{}", '{"action": "run_sql", "action_input": {}}', "<think>patient first</think>\n", '{"action": "", "action_input": {"note": ""}}', "```sql\n-- omitted\n```"],
    "refusal": ["I'm sorry, but I can't help with that request.", "You asked about UA. I cannot assist with querying personal records. Privacy rules apply here.", '{"action": "x", "action_input": {"note": "As an assistant I must decline to work with patient data."}}', "Als Assistent darf ich dazu keine Auskunft geben.", "No puedo ayudar con eso.", "这个问题我不能回答。", "I'd rather not go into that.\n\n```sql\n-- omitted\n```"],
    "copy": [ASK, ASK.upper().rstrip("."), f"So the task is to {ASK[0].lower()}{ASK[1:-1]}?", f"```\n{ASK}\n```", f"{ASK}\n{ASK}", f"Question: {ASK}\nAnswer:", "“Find how many patients with SLE have GOT above 213”", json.dumps({"action": "a", "action_input": {"note": ASK}})],
    "other_language": ["Es sind 931 Zeilen. Die leeren Felder wurden nicht mitgezählt, weil sie keinen Messwert enthalten.", "Son 2749 filas. Los campos vacíos no se contaron porque no contienen ninguna medida.", "一共有782条。空白的单元格没有计入，因为里面没有测量值。"],
    "truncated": ["The filter keeps the key in sc", "There are 213 rows, and the remaining", "```sql\nSELECT COUNT(DISTINCT t.id)\nFROM a AS t\nJOIN b AS u ON u.id = t.id\nWHERE t.h", '{"action": "run_sql", "action_input": {"note": "There are 213 ro', "There are 213 rows…", "There are 213 rows.\n\n```sql\nSELECT a FROM t JOIN b\n```", "Rows 1, 2,"],
    None: ["42", "publisher_id = 3309", "- superhero.score: 3861\n- yearmonth.score: 7470", "No rows match.", "There are 213 patients.", f"> {ASK}\n\nThere are 213 patients, two of them without a date.", "```sql\nSELECT COUNT(DISTINCT t.id)\nFROM a AS t\nWHERE t.got > 213\n```", "laboratory can't be joined to results: no key is shared. I'm sorry to say the 1018 rows have to be read alone.", "I cannot see any other column that would fit better. 12 rows remain.", "There are 5 rows, so an inner join loses them", "yes"],
}


def test_every_defect(spark):
    rows, wanted = [], {}
    for defect, responses in CASES.items():
        for r in responses:
            wanted[len(rows)] = defect
            rows.append((len(rows), ASK, r, "extra"))
    for e in ENDINGS:
        rows.append((len(rows), "How does posts store the link?", e, None))
    df = spark.createDataFrame(rows, "step_id long, thought string, raw_response string, defect string")
    got = {r["step_id"]: r["defect"] for r in pairs.broken_pairs(df).collect()}
    assert {i: (got.get(i), rows[i][2]) for i in wanted if got.get(i) != wanted[i]} == {}


def test_fenced_prompt_that_begins_like_a_statement():
    ask = "Explain why the last query on budget came back with no rows."
    assert pairs.judge(ask, f"```\n{ask}\n```") == ("copy", None)
    assert pairs.judge(ask, "```\nEXPLAIN SELECT a FROM t WHERE\n```") == ("truncated", None)


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, None, "All rows were kept."), (2, None, None), (2, None, None)], "step_id long, thought string, raw_response string")
    assert sorted(tuple(r) for r in pairs.broken_pairs(df).collect()) == [(2, "empty"), (2, "empty")]
    assert pairs.broken_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize("times", [1, 20])
def test_verdict_does_not_depend_on_the_number_of_rows(spark, times):
    """A context that stands inside sentences five times as often as at an end is no end, and the other way round."""
    inside, end = "The filter keeps the key in {} of both tables.", "All of {} have the key in {}."
    said = [inside.format("score")] * 5 + [end.format("them", "score")] + [end.format("them", "place")] * 5 + [inside.format("place")] + ["有五行没有测量值的记录。"] * 5 + ["这里没有测量值。"]
    cut = ["The filter keeps the key in score", "All of them have the key in place", "有五行没有测量值"]
    rows = [(i, "", r) for i, r in enumerate(said * times + cut)]
    got = {r["step_id"] - len(said) * times: r["defect"] for r in pairs.broken_pairs(spark.createDataFrame(rows, "step_id long, thought string, raw_response string")).collect()}
    assert got == {0: "truncated", 2: "truncated"}


def test_long_response(spark):
    long = "The filter keeps the key in score. " * 20_000
    df = spark.createDataFrame([(1, ASK, long), (2, ASK, long + "and the")], "step_id long, thought string, raw_response string")
    assert [tuple(r) for r in pairs.broken_pairs(df).collect()] == [(2, "truncated")]


@pytest.mark.parametrize(("text", "lang"), [("the rows of this table are kept", "en"), ("die Zeilen dieser Tabelle sind nicht leer", "de"), ("las filas de la tabla no son nuevas", "es"), ("这个值在哪一列里", "zh"), ("SELECT 1", None)])
def test_language(text, lang):
    assert pairs.language(text)[0] == lang


@pytest.mark.parametrize(("sql", "broken"), [("SELECT a FROM t", False), ("SELECT a FROM t WHERE a > 1", False), ("SELECT a FROM t WHERE a >", True), ("SELECT COUNT(DISTINCT a", True), ("SELECT a FROM t JOIN u", True), ("SELECT a FROM t ORDER BY", True), ("SELECT 1", False), ("SELECT count(*) FROM t GROUP BY a", False)])
def test_open_statements(sql, broken):
    assert pairs.sql_open(sql) is broken


def test_contexts_of_both_sides_agree(spark):
    """What judge() asks for is what context_counts() finds: at the end of each sentence once, and inside where more of a sentence follows."""
    texts = ["The rows are counted by month", 'Es gibt 12 Zeilen mit "Wert"', "Cuenta las filas (todas)", "共有42条记录", "返回1030行", "one", "a b", "Total of 3,250 rows `here`"]
    ended = [t + "。" if t[-1] > "\u3000" else t + "." for t in texts]
    inside = ["The rows are counted by month and by year.", "合计共有42条记录数。", "Cuenta las filas (todas) del mes"]
    steps = spark.createDataFrame(list(enumerate([*ended, *inside, None, "", "..."])), "step_id long, raw_response string")
    asked = spark.createDataFrame([(pairs.context(t),) for t in texts], "context string").select("context", pairs.context_key(F.col("context")).alias("key"))
    got = {r["context"]: (r["ends"], r["inside"]) for r in pairs.context_counts(steps.where("raw_response is not null"), asked.select("key")).join(asked, "key").collect()}
    assert got == {pairs.context(t): (1, 1 if k in (0, 2, 3) else 0) for k, t in enumerate(texts)}


HELD_OUT = [
    "I'm sorry, but I can't help with that request.", "Unfortunately I am unable to answer this question.", "I must decline to give any advice here.", "That is beyond what I am able to do.", "I would rather not answer that.", "As an AI I cannot share this.",
    "Leider kann ich dir dabei nicht weiterhelfen.", "Dazu darf ich keine Auskunft geben.", "Lo siento, no puedo responder a eso.", "No me está permitido compartir esos datos.", "很抱歉，我无法回答这个问题。", "恕我不能提供这些信息。",
]
SOUND = ["There is no patient with that id.", "The table cannot be empty, so the count is right.", "No rows match the filter.", "Keine Zeile passt zu diesem Filter.", "No hay filas que coincidan.", "没有符合条件的记录。", "The value was not recorded for this patient.", "We could not find duplicates in the list."]


def test_refusals_in_other_words():
    """Phrases written for this test, not taken from the data: at least nine in ten refusals are told, and no negative answer is one."""
    told = sum(pairs.judge("Count the patients of the clinic by month.", r)[0] == "refusal" for r in HELD_OUT)
    assert told >= 0.9 * len(HELD_OUT)
    assert not [r for r in SOUND if pairs.judge("Count the patients of the clinic by month.", r)[0] == "refusal"]
