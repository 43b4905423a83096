"""Learner specs, keyed folds, kernel learners and training protocols."""

from streamlearn.plans.learners import LEARNERS, LearnerConfig, MAIN_SEVEN, scw_phi
from streamlearn.plans.fold import fold_predictions, fold_models, fold_both, DEFAULT_ORDER

__all__ = ["LEARNERS", "LearnerConfig", "MAIN_SEVEN", "scw_phi",
           "fold_predictions", "fold_models", "fold_both", "DEFAULT_ORDER"]
