"""Every value of lang is learned, however many there are."""

from itemloom.llm import langid


def test_all_values_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_WINDOWS", 400)
    rows = [(10 * i + k, f"{chr(0x4E00 + 40 * i)} some text {k}", f"l{i:02}") for i in range(70) for k in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net, langs = langid.train(df)
    assert langs == [f"l{i:02}" for i in range(70)] and net.w["bias"].shape == (70,)
    assert langid.predict(df.drop("lang"), net, langs).filter("lang_pred <> 'und'").count() == 140
