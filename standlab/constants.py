"""Fixed values shared by the operators.

Several conversions exist in two roundings because published results depend on
which one was used; each operator names the constant it takes.
"""

# fixed values: expansion and geometry
TREES_PER_ACRE = 10.0          # one tallied tree stands for ten per acre (0.1-acre plots)
BASAL_AREA_FT2 = 0.005454      # square feet of basal area per square inch of diameter
SQFT_PER_ACRE = 43560.0

# fixed values: unit conversions
ACRES_PER_HA = 2.47
ACRES_PER_HA_FINE = 2.47105
FT_PER_M = 3.28
M_PER_FT = 0.3048
CM_PER_IN = 2.54
M_PER_IN = 0.0254
IN_PER_CM = 0.3937
FT2_AC_PER_M2_HA = 4.356
M3_HA_TO_FT3_AC = 14.28
FT3_AC_TO_M3_HA = 0.0698

# fixed values: species and treatment codes
SPECIES = ["BS", "NS", "RS", "WS"]
PURE = ["B", "N", "R", "W"]
MIXED = ["BN", "BR", "BW", "NR", "NW", "RW"]
CONTROL = "C"
TREATMENTS = PURE + MIXED + [CONTROL]

# fixed values: the pure stand a mixture is measured against in transgressive overyielding
BEST_PURE = {"BN": "N", "BR": "B", "BW": "W", "NR": "N", "NW": "N", "RW": "W"}

# fixed values: species x treatment pairs treated as planting errors
MISPLANTED = [("BW", "RS"), ("NR", "BS"), ("RW", "NS"), ("RW", "BS")]
MISPLANTED_CROWN = [("NR", "BS"), ("NR", "WS"), ("BN", "RS"), ("BN", "WS"),
                    ("RW", "BS"), ("RW", "NS"), ("BW", "RS"), ("BW", "NS")]

# fixed values: damage codes counted as weevil
WEEVIL_CODES = ["FK/WV", "WV"]

# fixed values: odds ratios of the species occurrence model (None = term not used)
SUITABILITY_ODDS = {
    "BS": {"intercept": 3.88, "vpdmax": 0.53, "ppt": 0.99, "tmax": None, "twi": 2.47, "wsi": None},
    "RS": {"intercept": 43.41, "vpdmax": 0.82, "ppt": None, "tmax": 0.80, "twi": None, "wsi": None},
    "WS": {"intercept": 26.94, "vpdmax": None, "ppt": None, "tmax": 0.71, "twi": None, "wsi": 0.99},
}
