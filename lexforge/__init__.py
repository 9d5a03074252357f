"""lexforge: Spark-native jobs that turn text tables into masked-LM training data.

Every operator is a function ``DataFrame -> DataFrame`` built from the DataFrame
API, so Catalyst plans it and Spark executes it on a cluster.  Sub-packages:

* ``functions``  - column expressions (text cleanup, hashing, array helpers)
* ``sources``    - scans and sinks (corpus, line files, token shards, artifacts)
* ``operators``  - relational operators (positions, sampling, vocab, BPE, encode,
  batching, masking, evaluation, run logs)
* ``plans``      - end-to-end jobs composed from the operators
* ``streaming``  - Structured Streaming batch assembly
"""

from lexforge.session import checkpoint_dir, get_session

__all__ = ["checkpoint_dir", "get_session"]
