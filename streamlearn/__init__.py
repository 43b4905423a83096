"""streamlearn: online classification on Spark.

Relational work (loading, labelling, splitting, scaling, perturbing, scoring,
evaluating, ranking) is expressed with DataFrame operators so Catalyst plans
it; sequential learners run as keyed folds over hash-partitioned, sorted
streams (see ``streamlearn.plans.fold``).
"""

from streamlearn.session import get_spark, checkpoint_dir, reliable_checkpoint

__all__ = ["get_spark", "checkpoint_dir", "reliable_checkpoint"]
