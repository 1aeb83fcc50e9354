"""The driver's memory: what nothing refers to is dropped inside the stages, not only after them."""

from graphloom.llm import common, language_id, mixing, near_dedup


def test_settling_collects_the_garbage_of_the_jvm(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    before = sum(b.getCollectionCount() for b in beans)
    common.settle_driver(spark)
    assert sum(b.getCollectionCount() for b in beans) > before


def test_the_stages_settle_the_driver_between_their_jobs(spark, monkeypatch):
    calls = []
    for m in (language_id, mixing, near_dedup):
        monkeypatch.setattr(m, "settle_driver", lambda s, name=m.__name__: calls.append(name))
    rows = [(i, f"common words of a text number{i % 7}", ("en", "de")[i % 2], f"s{i % 3}", 30) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    language_id.train_on(docs)
    near_dedup.keep_one_each(docs).count()
    mixing.mix_documents(docs).count()
    assert {m.__name__ for m in (language_id, mixing, near_dedup)} == set(calls)
    assert calls.count(near_dedup.__name__) >= 3  # in the loop of the components too
