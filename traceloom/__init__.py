"""Process intelligence over event logs, as PySpark DataFrame code."""

from .session import Scale, local_session, pin
from .spec import (
    BaselineSpec,
    Calendar,
    ContractSpec,
    DetectorSpec,
    MiningSpec,
    OpportunitySpec,
    ReferenceModel,
    ReviewSpec,
    Roles,
    governed_model,
    strict_model,
)

__all__ = [
    "BaselineSpec",
    "Calendar",
    "ContractSpec",
    "DetectorSpec",
    "MiningSpec",
    "OpportunitySpec",
    "ReferenceModel",
    "ReviewSpec",
    "Roles",
    "Scale",
    "governed_model",
    "local_session",
    "pin",
    "strict_model",
]
