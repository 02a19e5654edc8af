"""quarry — exploratory analytics and regression on Spark DataFrames.

Every public function takes a DataFrame (plus column names / parameters) and returns a
DataFrame; nothing data-sized is collected to the driver.
"""

__version__ = "0.1.0"
