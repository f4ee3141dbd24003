"""Fixed values of the road rules."""

#: Speeds in km/h of the drivable classes.
SPEEDS = {
    "motorway": 80, "trunk": 60, "primary": 50, "secondary": 40, "tertiary": 30, "unclassified": 25, "residential": 20, "living_street": 10,
    "service": 15, "track": 10, "motorway_link": 40, "trunk_link": 30, "primary_link": 25, "secondary_link": 20, "tertiary_link": 15,
}
#: Points of a settlement's status, and the weights of both rankings.
STATUS_POINTS = {"CUT OFF": 100.0, "UNCERTAIN": 40.0, "degraded": 20.0, "CONNECTED": 0.0}
SETTLEMENT_WEIGHTS = {"status": 1.0, "hospital": 50.0, "town": 20.0, "buildings": 10.0, "evidence": 5.0, "detour": 5.0}
LINK_WEIGHTS = {"settlements": 10.0, "buildings": 5.0, "hospital": 20.0, "town": 10.0, "evidence": 3.0}
