"""chatlake: Spark-native operators over chat-room message logs."""

__version__ = "0.1.0"
