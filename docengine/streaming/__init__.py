"""docengine.streaming"""
