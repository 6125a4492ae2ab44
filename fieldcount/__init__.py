"""fieldcount: stratified count surveys as Spark DataFrame operators."""

from fieldcount.design import Stratum, SurveyDesign

__all__ = ["Stratum", "SurveyDesign"]
