"""What expressions are made of."""

# Fixed values of the language.
FEATURES = ("open", "high", "low", "close", "volume", "return")
WINDOWS = (1, 5, 10, 20, 40, 60, 120, 252)
CONSTANTS = (-2.0, -1.0, -0.5, -0.01, 0.01, 0.5, 1.0, 2.0)
UNARY = ("Abs", "Sign", "Log")
BINARY = ("Add", "Sub", "Mul", "Div", "Greater", "Less")
ROLLING = ("Ref", "Delta", "Mean", "Sum", "Std", "Var", "Max", "Min", "Med", "Mad", "TSRank", "WMA", "EMA")
PAIR_ROLLING = ("Cov", "Corr")
CROSS_SECTION = ("CSRank", "CSZScore")
COMMUTATIVE = ("Add", "Mul")
MAX_DEPTH, MAX_NODES, MAX_LOOKBACK = 6, 21, 252

#: name -> number of expression arguments, and whether a window follows
OPERATORS = {**{n: (1, False) for n in UNARY + CROSS_SECTION}, **{n: (2, False) for n in BINARY}, **{n: (1, True) for n in ROLLING}, **{n: (2, True) for n in PAIR_ROLLING}}
