"""The named reports. Importing this package fills the registry."""

from govlens.plans.reports import coding, health, overview, security, tokenomics
from govlens.plans.reports.registry import REPORTS, Report, report, run

__all__ = ["REPORTS", "Report", "report", "run", "coding", "health", "overview", "security", "tokenomics"]
