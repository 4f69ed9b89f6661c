"""Case-surveillance analytics as PySpark DataFrame plans."""

from caseframe.model import AttributeCodes, CaseDefinition, ReportParams, Scope

__all__ = ["AttributeCodes", "CaseDefinition", "ReportParams", "Scope"]
