"""ibex: labelled-text analytics, stochastic latent classifiers and training-text preparation on Spark."""

__version__ = "0.1.0"
