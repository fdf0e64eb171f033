"""Operators for training-data pipelines, written as Spark jobs.

| operator | module |
| --- | --- |
| license scan | `licenses.py` |
| suffix-array dedup | `suffixes.py` |
| quality rules | `quality_rules.py` |
| language-model scoring | `lm.py` |
| substring (line) dedup | `lines.py` |
| toxicity | `toxicity.py` |
| benchmark decontamination | `decontaminate.py` |
| n-gram Jaccard join | `jaccard.py` |
| packing | `packing.py` |
| sharding | `sharding.py` |

`flat.py` and `common.py` hold what several of them share, `queries.py`
registers one query per operator.  Nothing outside this subpackage imports it.
"""
