"""Weights, sets, grids and word lists that results depend on."""

# threat weight by incident (canonical feature row), and its default
THREAT_WEIGHT = {
    "Score": 5.0, "PlayerGoals": 5.0, "Penalties": 4.0, "MissedPenalty": 3.0, "RedCard": 4.0, "PlayerRedCard": 4.0,
    "YellowCard": 1.5, "PlayerYellowCard": 1.5, "PlayerShotsOnTarget": 2.0, "ShotsOnTarget": 2.0,
    "PlayerShotsOffTarget": 1.0, "ShotsOffTarget": 1.0, "Corners": 1.2, "DangerousAttacks": 0.8, "Attacks": 0.4,
    "Possession": 0.1, "Timer": 0.0, "Period": 0.0,
}
THREAT_DEFAULT = 0.2
HIGH_RISK = ("Score", "PlayerGoals", "Penalties", "RedCard", "PlayerRedCard", "YellowCard", "PlayerShotsOnTarget", "ShotsOnTarget", "MissedPenalty", "VAR")
HIGH_IMPACT = ("Score", "PlayerGoals", "Penalties", "MissedPenalty", "RedCard", "PlayerRedCard", "VAR")
TIMER_KINDS = ("Timer", "Period")
MARKER_NOISE = ("Timer", "Period", "Player Completed Passes (Raw)", "Player Passes", "Player Minutes Played", "Player Successes Tackles Percentage")

# weight by upper-cased event type, and its default
EVENT_WEIGHT = {
    "GOAL": 5.0, "PENALTY": 4.0, "RED_CARD": 4.0, "YELLOW_RED_CARD": 3.5, "SHOT_ON_TARGET": 2.0, "SHOT_OFF_TARGET": 1.2,
    "CORNER": 1.5, "DANGEROUS_ATTACK": 1.0, "ATTACK": 0.5, "POSSESSION": 0.1,
}
EVENT_WEIGHT_DEFAULT = 0.1
HIGH_RISK_EVENTS = ("GOAL", "PENALTY", "RED_CARD", "YELLOW_RED_CARD", "SHOT_ON_TARGET", "SHOT_OFF_TARGET", "CORNER", "DANGEROUS_ATTACK", "ATTACK")

# incident names made canonical (others become "other"), and their weights
CANONICAL = {
    "Score": "score", "DangerousAttacks": "dangerous_attack", "Attacks": "attack", "PlayerShotsOnTarget": "shot_on_target",
    "PlayerShotsOffTarget": "shot_off_target", "Player Yellow Card": "yellow_card", "Player Red Card": "red_card",
    "Corner Kicks": "corner", "Goal": "goal", "Timer": "timer", "Period": "period",
}
CANONICAL_WEIGHT = {
    "goal": 5.0, "red_card": 4.0, "shot_on_target": 2.0, "shot_off_target": 1.2, "corner": 1.5, "dangerous_attack": 1.0,
    "attack": 0.5, "yellow_card": 0.8, "timer": 0.1,
}

# substring weights, the first match in this order counts
SUBSTRING_WEIGHT = (
    ("goal", 1.0), ("shot on target", 0.6), ("shot off target", 0.3), ("penalty", 0.9), ("red card", 0.8), ("yellow card", 0.3),
    ("corner kick", 0.25), ("free kick", 0.2), ("dangerous attack", 0.35), ("offside", 0.1), ("substitution", 0.05),
    ("injury", 0.4), ("var", 0.5), ("score", 0.7), ("period", 0.1),
)
SUBSTRING_DEFAULT = 0.05
RISK_SUBSTRINGS = ("goal", "penalty", "red card", "shot on target", "var", "injury", "score")

# upper edges (exclusive) of score-difference and minute buckets
SCORE_EDGES = (-3, -2, -1, 0, 1, 2, 3)
TIME_EDGES = (15, 30, 45, 60, 75, 90)
VOLATILITY_EDGES = (0.01, 0.02, 0.05, 0.10, 0.20)

# threat grid, 12 cells along the pitch by 8 across
THREAT_GRID = (
    (0.00, 0.00, 0.01, 0.01, 0.01, 0.02, 0.02, 0.03),
    (0.00, 0.01, 0.01, 0.01, 0.02, 0.02, 0.03, 0.04),
    (0.01, 0.01, 0.01, 0.02, 0.02, 0.03, 0.04, 0.06),
    (0.01, 0.01, 0.02, 0.02, 0.03, 0.04, 0.06, 0.10),
    (0.01, 0.01, 0.02, 0.03, 0.04, 0.06, 0.10, 0.15),
    (0.01, 0.02, 0.02, 0.03, 0.05, 0.08, 0.14, 0.20),
    (0.02, 0.02, 0.03, 0.05, 0.07, 0.12, 0.20, 0.30),
    (0.02, 0.02, 0.04, 0.06, 0.09, 0.15, 0.25, 0.35),
    (0.03, 0.03, 0.05, 0.08, 0.12, 0.20, 0.32, 0.42),
    (0.04, 0.04, 0.07, 0.10, 0.16, 0.26, 0.38, 0.47),
    (0.05, 0.06, 0.09, 0.14, 0.22, 0.34, 0.45, 0.52),
    (0.08, 0.10, 0.14, 0.20, 0.30, 0.43, 0.56, 0.65),
)

# words that say nothing about a team
NOISE_TOKENS = (
    "fc", "sc", "ac", "cf", "rc", "fk", "sk", "bk", "if", "hb", "sf", "afc", "sfc", "rsc", "vfb", "vfl", "bvb", "asc",
    "united", "city", "town", "athletic", "athletics", "sport", "sporting", "borussia", "real", "atletico", "deportivo",
    "club", "de", "la", "le", "les",
)
MAJOR_LEAGUES = (
    "UEFA Champions League", "UEFA Europa League", "UEFA Conference League", "Premier League", "La Liga", "Serie A", "Bundesliga",
    "Ligue 1", "Copa Libertadores", "Copa Sudamericana", "MLS", "Liga MX", "Champions League", "Europa League",
)
# Patterns of a market's question that tell another sport or subject
OTHER_SPORTS = (
    r"\bLoL\b", r"\bCS2\b", r"\bCSGO\b", r"Counter.Strike", r"\bDota\b", r"\bValorant\b", r"\bEsport", r"Map \d+ Winner", r"Map Handicap", r"Game \d+ Winner",
    r"Game Handicap", r"\bKill Handicap\b", r"\bBO3\b", r"\bBO5\b", r"LCS\b", r"\bLEC\b", r"\bLCK\b", r"\bLPL\b", r"\bLES\b", r"League of Legends", r"Teamfight Tactics",
    r"\bMLB\b", r"\bMets\b", r"\bYankees\b", r"\bRed Sox\b", r"\bWhite Sox\b", r"\bBlue Jays\b", r"\bRays\b", r"\bBrewers\b", r"\bCardinals\b", r"\bCubs\b", r"\bRockies\b",
    r"\bDodgers\b", r"\bGiants vs\.", r"\bDiamondbacks\b", r"\bMariners\b", r"\bRangers vs\.", r"\bAstros\b", r"\bPhillies\b", r"\bBraves\b", r"\bNationals\b", r"\bOrioles\b",
    r"\bPirates\b", r"\bPadres\b", r"\bAngels\b", r"\bAthletics\b", r"\bTigers\b", r"\bTwins\b", r"\bRoyals\b", r"\bGuardians\b", r"run scored in the first inning",
    r"\bNBA\b", r"\bCavaliers\b", r"\bThunder\b", r"\bSpurs\b", r"\bKnicks\b", r"\bCeltics\b", r"\bWarriors\b", r"\bLakers\b", r"\bNuggets\b", r"\bSuns\b", r"\bMavericks\b",
    r"\bHeat\b", r"\bBucks\b", r"\bNets\b", r"\b76ers\b", r"\bPacers\b", r"\bHawks\b", r"\bHornets\b", r"\bWizards\b", r"\bPistons\b", r"O/U \d{3}\.", r"Odd/Even Score",
    r"Pallacanestro", r"KK Crvena Zvezda", r"Partizan", r"\bITF\b", r"Roland Garros", r"Internazionali BNL", r"\bATP\b", r"\bWTA\b", r"Open ATP", r"Open WTA", r"Set \d+ Winner",
    r"Game \d+, Set", r"\bNFL\b", r"\bPackers\b", r"\bChiefs\b", r"\bEagles\b", r"\bPatriots\b", r"\bSteelers\b", r"\b49ers\b", r"\bUFC\b", r"\bMMA\b", r"\bPound-for-Pound\b",
    r"\bRodeo\b", r"presidential", r"gubernatorial", r"senatorial", r"\b2028\b.*win", r"win the.*2026.*election", r"\bNHL\b", r"\bStanley Cup\b", r"Ranked first",
)
# General football terms, as words
FOOTBALL_TERMS = (
    "soccer", "football", "Both Teams to Score", "BTTS", "Clean Sheet", "Half[- ]Time", "Full[- ]Time", "HT/FT", "Exact Score", "Correct Score",
    "First Goalscorer", "Last Goalscorer", "Anytime Goalscorer", "Total Goals", r"O/U [0-9]\.[05] (?:Goals|\(Goals)",
    "Will .* (?:win|draw|score) .* (?:match|game|league|cup|title)", "win .* Bundesliga", "win .* Premier League", "win .* Serie A", "promotion .* Bundesliga",
    "score .* most goals .* (?:World Cup|Copa|Euro|Nations)", "win .* (?:World Cup|Copa America|Champions League|Europa League)",
)
WIN_ON_DATE = r"Will .+(?:FC|SC|CF|AC|AS|CD|CA|SD|UD|SSC|BFC|AFC|SV|VfB|VfL|TSG|FSV).+win on \d{4}-\d{2}-\d{2}"
