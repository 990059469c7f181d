"""tallyfolio: brokerage-ledger analytics for many portfolios in one Spark job."""

from tallyfolio.plans.pipeline import PipelineInputs, analyze, load_exports

__all__ = ["PipelineInputs", "analyze", "load_exports"]
