"""quillstone.streaming"""
