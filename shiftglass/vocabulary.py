"""The names that rows may carry."""

EVENT_TYPES = ("ENTERED_ZONE", "EXITED_ZONE", "LOST_IN_ZONE", "REAPPEARED", "DWELL_WARNING", "DWELL_EXCEEDED", "PPE_VERDICT_CHANGED")
STATUSES = ("COMPLIANT", "POTENTIAL_VIOLATION", "UNVERIFIABLE")
REVIEW_STATES = ("NOT_REQUIRED", "PENDING", "CONFIRMED", "DISMISSED")
RULE_TYPES = ("PPE_ENTRY", "PPE_CONTINUOUS", "MAX_DWELL", "REQUIRED_EXIT", "MAN_DOWN", "OCCUPANCY", "WALK_ONLY")
PPE_RULES = ("PPE_ENTRY", "PPE_CONTINUOUS")
RULE_ZONE_TYPES = ("PPE_CHECKPOINT", "APPROACH", "RESTRICTED", "EXIT")
ZONE_TYPES = (*RULE_ZONE_TYPES, "GENERAL")
SEVERITIES = ("INFO", "WARNING", "CRITICAL")
ACTION_STATES = ("OPEN", "IN_PROGRESS", "CLOSED", "CANCELLED")
TRANSIT = "TRANSIT_ZONE"
ITEMS = ("helmet", "safety_vest")
