"""vigil: comment-moderation analytics on Spark.

Classify comments with a lexicon or a Spark ML model, replay a log of
detections, deletions and moderator decisions into a pending queue and an
action history, fold moderator feedback into a deduplicated training set,
evaluate and train classifiers, and scan crawled pages against block lists.
Everything is a DataFrame / Spark SQL / Spark ML / Structured Streaming plan.
"""

__version__ = "0.1.0"
