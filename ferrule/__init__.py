"""Spark-native search and analysis of source trees and their metadata."""
