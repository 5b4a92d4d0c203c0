"""millrace: Spark jobs for language-model training data and evaluation results.

DataFrame in, DataFrame out.  The subpackages:

* ``functions``  - column expressions (text, arrays, answers, seeded numbers)
* ``operators``  - DataFrame operators (ordering, packing, mixtures, batches, grading, bookkeeping)
* ``sources``    - readers and writers
* ``plans``      - whole jobs put together from the operators
* ``streaming``  - Structured Streaming jobs
* ``catalog``    - the registered queries with their SQL counterparts
"""
