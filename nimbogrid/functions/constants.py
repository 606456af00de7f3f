"""Physical constants (SI units)."""

GRAVITY = 9.80665
EARTH_RADIUS = 6.37122e6
R_DRY = 287.04
CP_DRY = 1004.64
CV_DRY = CP_DRY - R_DRY
R_VAP = 461.50
CP_VAP = 1846.00
CV_VAP = CP_VAP - R_VAP
C_LIQUID = 4218.0
C_ICE = 2106.0
T0 = 273.15
P00 = 100000.0
PSAT0 = 610.78
LHV0 = 2.501e6
LHS0 = 2.834e6
LHF0 = LHS0 - LHV0
LHV00 = LHV0 - (CP_VAP - C_LIQUID) * T0
LHS00 = LHS0 - (CP_VAP - C_ICE) * T0
EPS_VAP = R_DRY / R_VAP
EPST_VAP = 1.0 / EPS_VAP - 1.0
#: Heat capacities at constant volume of vapour, liquid (cloud, rain) and ice (ice, snow, graupel).
CV_TRACERS = {"qv": CV_VAP, "qc": C_LIQUID, "qr": C_LIQUID, "qi": C_ICE, "qs": C_ICE, "qg": C_ICE}
#: Sentinels for missing values in files; they become null when read.
UNDEFINED = (-9.9999e30, -9.99e33, -32768.0)
