"""DataFrame operators. Every function takes and returns DataFrames and plans lazily unless it says otherwise."""
