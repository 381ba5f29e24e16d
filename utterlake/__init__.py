"""utterlake: speech-corpus and voice-event analytics on PySpark DataFrames."""
