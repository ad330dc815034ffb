import json

from inkprint.sources import collection as S
from inkprint.sources import results as R


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")


def collection(base):
    write(base / "collection-info.json", [{"problem-name": "problem00002", "language": "fr"},
                                          {"problem-name": "problem00001", "language": "en"}])
    p = base / "problem00001"
    write(p / "problem-info.json", {"unknown-folder": "unknown", "candidate-authors": [
        {"author-name": "candidate00001"}, {"author-name": "candidate00002"}]})
    write(p / "candidate00001" / "known00001.txt", "one\ntwo é")
    write(p / "candidate00002" / "known00001.txt", "other")
    write(p / "candidate00002" / "a+b %c.txt", "odd name")
    write(p / "nobody" / "known00001.txt", "not used")
    write(p / "unknown" / "unknown00001.txt", "who?")
    write(p / "ground-truth.json", {"ground_truth": [
        {"unknown-text": "unknown00001.txt", "true-author": "<UNK>"}]})
    write(p / "fandom-info.json", [{"author-name": "fan00001"}])


def test_collection(spark, tmp_path):
    collection(tmp_path)
    base = str(tmp_path)
    problems = S.read_collection(spark, base)
    assert [tuple(r) for r in problems.orderBy("idx").collect()] == [
        (0, "problem00002", "fr"), (1, "problem00001", "en")]
    kept = S.slice_problems(problems, 1).collect()
    assert [(r["problem"], r["language_name"]) for r in kept] == [("problem00001", "english")]
    info = S.read_problem_info(spark, base)
    split = S.train_test(S.read_documents(spark, base), info)
    rows = {(r["author"], r["doc_name"], r["split"], r["text"]) for r in split.collect()}
    assert rows == {("candidate00001", "candidate00001/known00001.txt", "known", "one\ntwo é"),
                    ("candidate00002", "candidate00002/known00001.txt", "known", "other"),
                    ("candidate00002", "candidate00002/a+b %c.txt", "known", "odd name"),
                    ("candidate00002", "candidate00002/a+b %c.txt", "known", "odd name"),
                    (None, "unknown00001.txt", "unknown", "who?")}
    assert [tuple(r) for r in S.read_truth(spark, base).collect()] == [
        ("problem00001", "unknown00001.txt", "<UNK>")]
    assert [tuple(r) for r in S.read_fandom(spark, base).collect()] == [("problem00001", "fan00001")]


def test_answers(spark, tmp_path):
    write(tmp_path / "answers-p1.json", [
        {"unknown-text": "u1", "predicted-author": "a"}, {"unknown-text": "u1", "predicted-author": "b"}])
    answers = S.first_answers(S.read_answers(spark, str(tmp_path)))
    assert [tuple(r) for r in answers.collect()] == [("p1", "u1", "a")]
    R.write_answers(answers, str(tmp_path / "out"))
    more = spark.createDataFrame(
        [("p 1+%", "u1", "a"), ("p 1+%", "u2", None), ("p2", "u1", "x\"y")],
        "problem string, doc_name string, predicted_author string")
    for rows in (answers, more):
        R.write_answers(rows, str(tmp_path / "out"))
        back = S.first_answers(S.read_answers(spark, str(tmp_path / "out")))
        assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)


def test_other_readers(spark, tmp_path):
    write(tmp_path / "impo" / "fr" / "text1.txt", "un\ndeux")
    assert [tuple(r) for r in S.read_imposters(spark, str(tmp_path / "impo")).collect()] == [
        ("fr", "text1.txt", "un\ndeux")]
    write(tmp_path / "dict.txt", "RECORD  R AH0 K AO1 R D\nRECORD(1)  R EH1 K ER0 D\n")
    rows = [tuple(r) for r in S.read_pronunciations(spark, str(tmp_path / "dict.txt")).orderBy("variant").collect()]
    assert rows == [("record", 1, "r ah0 k ao1 r d"), ("record", 2, "r eh1 k er0 d")]
    write(tmp_path / "phones.txt", "AA\tvowel\nB\tstop\n")
    assert [tuple(r) for r in S.read_phones(spark, str(tmp_path / "phones.txt")).collect()] == [
        ("aa", "vowel"), ("b", "stop")]
    write(tmp_path / "words.txt", "the\n\"\nof\n")
    assert [r[0] for r in S.read_lexicon(spark, str(tmp_path / "words.txt")).collect()] == ["the", '"', "of"]


def test_write_evaluation(spark, tmp_path):
    per_problem = spark.createDataFrame([("p", 0.5, 0.6, 0.7)],
                                        "problem string, macro_f1 double, macro_precision double, macro_recall double")
    overall = spark.createDataFrame([(0.5,)], "overall_score double")
    R.write_evaluation(per_problem, overall, str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e/problems")).first()["macro-f1"] == 0.5
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "e/evaluation.prototext")).collect())
    assert text.startswith('measure {\n key: "mean macro-f1"\n value: "0.5"\n}')
