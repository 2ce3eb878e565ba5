from wayloom.llm import jaccard_join, store, toxicity


def test_swept_collects_garbage(spark):
    """In local mode the driver is the executor: its collector has run at least once more for it."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    runs = lambda: sum(b.getCollectionCount() for b in beans())
    before = runs()
    store.swept(spark)
    assert runs() > before
    assert jaccard_join.swept is toxicity.swept is store.swept
