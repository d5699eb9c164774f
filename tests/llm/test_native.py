"""The operators marked native run on DataFrame functions alone."""

import re

from grantweave.llm import fingerprints, licenses, sharding


def test_plans_have_no_python(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plans = [fingerprints.document_fingerprints(docs), fingerprints.edited_fingerprints(docs), licenses.scan(docs), sharding.write_shards(docs)]
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|MapInArrow|ArrowEval|CartesianProduct|BroadcastNestedLoop", plan)
