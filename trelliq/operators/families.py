"""Roots of the model families: what every member of one can do, for code that takes any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions.display import Described


class MixtureFamily(Described):
    """Rows drawn from one of several components: ``responsibilities``, ``loglikelihood``, ``fit``, ``sample``."""

    def labels(self, df: DataFrame) -> DataFrame:
        """``df`` with ``label``, each row's most probable component from 1, of equal ones the first."""
        scored = self.responsibilities(df)
        return scored.withColumn("label", F.array_position("gamma", F.array_max("gamma")).cast("int")).drop("gamma")


class EmissionFamily(Described):
    """Densities of one step's observation: ``logpdf``, ``sample``, ``fit``."""


class RegressionFamily(EmissionFamily):
    """Emissions that depend on inputs through ``beta``."""

    #: Of a linear predictor its mean response; the identity unless a family says otherwise.
    family = None

    def predict(self, df: DataFrame, u: str = "u") -> DataFrame:
        """``df`` with ``mean``, the expected outputs at each row's inputs, as an array."""
        etas = self.predictor_exprs(E.elements(F.col(u), self.input_dim))
        if self.family == "bernoulli":
            etas = [E.logistic(eta) for eta in etas]
        elif self.family == "poisson":
            etas = [F.exp(F.greatest(F.least(eta, F.lit(30.0)), F.lit(-30.0))) for eta in etas]
        return df.withColumn("mean", F.array(*etas))


class MarkovFamily(Described):
    """Trials driven by a hidden chain of states: ``loglikelihood``, ``class_probabilities``, ``viterbi``, ``fit``."""

    def total_loglik(self, obs: DataFrame) -> float:
        """Log-likelihood of all trials together; 0 without any."""
        return float(self.loglikelihood(obs).agg(F.sum("loglik")).first()[0] or 0.0)


class DynamicalFamily(Described):
    """Trials driven by a continuous latent path: ``smooth``, ``fit``, ``sample``."""


class StateFamily(Described):
    """How a latent path starts and moves."""


class ObservationFamily(Described):
    """How a latent path is observed."""
